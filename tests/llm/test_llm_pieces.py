import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import documents
from pitpanel.llm import arrowtext as at, piece_spans as ps

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return ps.Codec(Path(PATH).read_bytes())


def odd_texts(n=300):
    odd = [
        "", " ", "  ", "\n", "a", " a", "a ", "  a  b ", "Hello  wörld\n▁ 漢𝕏", "▁", "▁▁a▁ b", "a▁b", "<s> </s> <unk> <0x41>", "\x00\x01", "\t\tx", "é́", "𝕏", "𝕏𝕏 𝕏",
        " x　y", "a" * 3000, "the " * 500, "🙂🙃", "\r\nabc", "http://x.y/z?q=1&r=2", "null\u0000", "�", "\U0010ffff",
    ]
    rng = random.Random(3)
    letters = ["a", "b", "the", " ", "  ", "\n", "▁", "é", "漢", "𝕏", ".", "ing", "\t", "0", "́", "Ω"]
    return odd + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def own(codec, texts):
    ids, begins, ends, offsets = codec.encode(pa.array(texts, pa.string()))
    data, bounds = codec.decode(ids, offsets)
    back = at.strings(data, bounds).to_pylist()
    cut = lambda x, k: x[offsets[k] : offsets[k + 1]].tolist()
    return [(cut(ids, k), cut(begins, k), cut(ends, k), back[k]) for k in range(len(texts))]


def of_library(library, text):
    ids = library.encode(text, add_bos=True, add_eos=True)
    proto = library.encode(text, return_type="proto")
    spans = [(0, 0), *[(p.begin, p.end) for p in proto.pieces], (len(text.encode()), len(text.encode()))]
    return ids, [i for i, _ in spans], [j for _, j in spans], library.decode(ids)


def test_ids_spans_and_texts_equal_the_library(codec, library):
    texts = odd_texts()
    for text, got in zip(texts, own(codec, texts)):
        assert got == of_library(library, text), repr(text)


def test_chunks_of_a_long_text_change_nothing(codec, library, monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["word", " ", "  ", "é", "▁", "\n", "𝕏 ", "of the "]) for _ in range(400)) for _ in range(30)] + ["", "x" * 900]
    whole = own(codec, texts)
    monkeypatch.setattr(ps, "CHUNK", 40)
    assert own(codec, texts) == whole and whole[0] == of_library(library, texts[0])


def test_any_ids_decode_as_in_the_library(codec, library):
    rng = random.Random(6)
    rows = [[rng.randrange(0, 300) if rng.random() < 0.7 else rng.randrange(codec.kinds.size) for _ in range(rng.randrange(0, 12))] for _ in range(400)]
    rows += [[codec.id["▁"]], [codec.id["▁"], codec.id["▁"]], [1, 2], [int(codec.byte[0xE6]), int(codec.byte[0xBC])], [0, 0]]
    offsets = np.cumsum([0, *map(len, rows)])
    data, bounds = codec.decode(np.array([i for r in rows for i in r], np.int64), offsets)
    for row, text in zip(rows, at.strings(data, bounds).to_pylist()):
        assert text == library.decode(row), row


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
def test_character_maps_equal_the_library(rule):
    """Normalised text and the source of every character, with maps whose prefixes span several characters."""
    for flags in ({}, {"remove_extra_whitespaces": True}, {"add_dummy_prefix": True, "remove_extra_whitespaces": True, "escape_whitespaces": True}):
        n = sentencepiece.SentencePieceNormalizer(rule_name=rule, **flags)
        spec = next(v for k, v in ps.fields(n.serialized_model_proto()) if k == 3)
        mine = ps.Normaliser(spec)
        texts = odd_texts() + ["ｱﾊﾟｰﾄ ①", "ｶﾞｶﾞ ｶ", "¨x", " 　 ｶﾞ ", "​​", "Å Å", "ﷺ", "é́ ", "Ⅳ  ﬁ"]
        data, offsets = at.flat(pa.array(texts, pa.string()))
        out, bound, source, end = mine.run(data, offsets)
        for k, text in enumerate(texts):
            want, places = n.normalize(text, with_offsets=True)
            assert out[bound[k] : bound[k + 1]].tobytes().decode() == want, (flags, repr(text))
            raw = text.encode()
            mine_at = [len(raw[: s - offsets[k]].decode()) for s in source[bound[k] : bound[k + 1]].tolist()]
            at_char = [m for m, b in zip(mine_at, want.encode()) if b & 0xC0 != 0x80]
            assert at_char == list(places)[: len(at_char)], (flags, repr(text))
            assert len(raw[: end[k] - offsets[k]].decode()) == list(places)[-1] or not want, (flags, repr(text))


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        ps.Codec(b"")


def test_rows(spark, edges, empty, library):
    got = ps.encoded(edges, PATH, decode=True).collect()
    assert len(got) == edges.count()
    text_of = {(r.doc_id, r.text) for r in edges.collect()}
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert any(i == r.doc_id and library.encode(t or "", add_bos=True, add_eos=True) == ids and library.decode(ids) == r.decoded for i, t in text_of), r.doc_id
    assert ps.encoded(empty, PATH).collect() == []
    again = {(r.doc_id, r.decoded) for r in ps.decoded(ps.encoded(edges, PATH), PATH).collect()}
    assert again == {(r.doc_id, r.decoded) for r in got}


def test_query_equals_the_library(spark, library):
    import hashlib

    from conftest_llm import SF
    from pitpanel.llm.queries import QUERIES

    text = {r.doc_id: r.text or "" for r in documents(spark).collect()}
    for r in QUERIES["op13_piece_spans"](spark, SF).collect():
        ids = library.encode(text[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
