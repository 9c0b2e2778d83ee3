"""Secrets in whole texts: fixed patterns, and a linear-chain conditional random field that adds spans.

Tokens are runs of letters, digits and `+/_-`, or runs of other visible characters; a chain is a line, cut
after a full stop, question or exclamation mark that a space follows. A token's score for each tag (outside, begin, inside)
is a sum of weights of its own shape, the shapes of the two tokens before and the one after, and two features
of its document. Viterbi finds the best tags of a chain. A chain in which no token can score above
"outside", whatever its neighbours' tags, needs no search: outside is then the best path.

Training: chains of at most TRAIN_DOCS documents, those with the smallest hashes of their ids; tags come from
the fixed patterns, MADE lines with invented keys of other makes teach shapes that the patterns leave out, and as many lines
with numbers, dates, addresses and identifiers teach what is no key.
The weights are fitted in numpy by forward-backward gradients on the driver; the sample's size is the bound (of chains
without a secret, PLAIN_CHAINS).

Output, one row per input row: doc_id, base (kind:start:end of pattern matches), spans (all of them),
n_assign, n_access, n_hex. Positions are code points, ends exclusive; a tagged span that touches a pattern match
is dropped, the others have the kind `crf`.

Defined cases. Null or empty text: no spans. Null id: passed through. Repeated rows: one result each. Empty
table, or no tagged token in the sample: patterns and made lines alone teach. Ties of two paths: the lower
tag. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pitpanel.llm import arrowtext as at

# The patterns of the base, their prefilters, words that announce a secret.
KEYWORDS = "password|passwd|secret|token|api_?key"
ASSIGN = re.compile(rf"""((?i:{KEYWORDS}))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MAYBE = {"assign": rf"""(?i)({KEYWORDS})["']?\x20*[:=]""", "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}"}
KINDS = ("assign", "access", "hex", "crf")
TRIGGERS = "password passwd secret token apikey api_key key pwd auth bearer credential credentials access private".split()

TRAIN_DOCS = 4096
MADE = 600
#: Log-odds of "begin" over "outside" that a tagged span needs before it is replaced in a text; see README for its precision.
SURE = 2.0
#: Bytes of text that are tagged at once; about forty times as much memory is in use meanwhile.
SLICE = 1 << 20
SNIPPET = 240
CHAIN = 32
PLAIN_CHAINS = 3000
O, B, I = 0, 1, 2

KIND = np.full(256, 2, np.uint8)
KIND[at.WHITE] = 0
KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"+/_-", *range(0x80, 0x100)]] = 1


def base_spans(text: str, kinds=("assign", "access", "hex")) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pattern matches, in order of start and then kind."""
    out = []
    if "assign" in kinds:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "access" in kinds:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if "hex" in kinds:
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


class Tokens:
    """Tokens of a batch of texts: byte places, text number, chain starts, and shape features of distinct tokens."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = at.flat(texts)
        d = self.data
        kind = KIND[d]
        change = np.ones(len(d), bool)
        change[1:] = kind[1:] != kind[:-1]
        change[self.offsets[:-1][np.diff(self.offsets) > 0]] = True
        seen = kind != 0
        self.start = np.flatnonzero(change & seen)
        stop = np.flatnonzero(np.append(change[1:], True)[: len(d)] & seen) + 1
        self.stop = stop
        self.row = np.searchsorted(self.offsets, self.start, "right") - 1
        packed = np.concatenate([[0], np.cumsum(stop - self.start)]).astype(np.int64)
        coded = at.strings(d[seen], packed).dictionary_encode()
        self.which = coded.indices.to_numpy(zero_copy_only=False)
        self.shape = shapes(coded.dictionary)
        n = len(self.start)
        new = np.ones(n, bool)
        if n > 1:
            feeds = np.cumsum(d == 0x0A)
            end_mark = np.isin(d[stop[:-1] - 1], list(b".!?")) & (self.start[1:] > stop[:-1])
            new[1:] = (self.row[1:] != self.row[:-1]) | (feeds[self.start[1:]] != feeds[stop[:-1] - 1]) | end_mark
        self.chain = np.flatnonzero(new)
        # Two features of a document: a hundredth of its tokens mix letters and digits; a hundredth hold an equals sign.
        texts_n = len(self.offsets) - 1
        count = np.maximum(1, np.bincount(self.row, minlength=texts_n))
        share = lambda f: np.bincount(self.row, self.shape[self.which, f], texts_n) * 100 >= count
        self.file = np.stack([share(MIXED), share(EQUALS)], axis=1).astype(np.float32) if n else np.zeros((texts_n, 2), np.float32)


SHAPES = 21
MIXED, EQUALS = 7, 16


def shapes(distinct: pa.Array) -> np.ndarray:
    d, o = at.flat(distinct)
    n = len(distinct)
    out = np.zeros((n, SHAPES), np.float32)
    if not n:
        return out
    size = np.diff(o)
    count = lambda m: np.add.reduceat(m.astype(np.int32), o[:-1])
    span = lambda a, b: (d >= ord(a)) & (d <= ord(b))
    digit, lower, upper = span("0", "9"), span("a", "z"), span("A", "Z")
    digits, lowers, uppers = count(digit), count(lower), count(upper)
    hexes, high = count(digit | span("a", "f")), count(d >= 0x80)
    letters = lowers + uppers
    lowered = pc.ascii_lower(distinct)
    known = lambda a: pc.fill_null(a, False).to_numpy(zero_copy_only=False)
    out[:, 0] = 1
    out[:, 1] = KIND[d[o[:-1]]] == 2
    for k, least in enumerate((6, 12, 20, 32)):
        out[:, 2 + k] = size >= least
    out[:, 6] = digits > 0
    out[:, 7] = (digits > 0) & (letters > 0)
    out[:, 8] = (hexes == size) & (size >= 12)
    out[:, 9] = (uppers >= 2) & (lowers >= 1)
    out[:, 10] = (digits >= 3) & (letters >= 3)
    out[:, 11] = count(np.isin(d, list(b"+/_-"))) > 0
    out[:, 12] = high > 0
    out[:, 13] = known(pc.starts_with(distinct, "AKIA"))
    out[:, 14] = known(pc.is_in(lowered, pa.array(TRIGGERS, lowered.type)))
    out[:, 15] = known(pc.match_substring_regex(lowered, KEYWORDS))
    out[:, 16] = count(d == ord("=")) > 0
    out[:, 17] = count(d == ord(":")) > 0
    out[:, 18] = count(np.isin(d, list(b"\"'`"))) > 0
    out[:, 19] = lowers == size
    out[:, 20] = (digits + uppers == size) & (size >= 16)
    return out


class Field:
    """Weights of the chain: own, two before, one after, document, transitions, start."""

    def __init__(self, w: np.ndarray, file: np.ndarray, move: np.ndarray, start: np.ndarray):
        self.w, self.file, self.move, self.start = w, file, move, start

    def scores(self, t: Tokens) -> np.ndarray:
        """Score of each tag for each token; a neighbour counts only inside the chain."""
        n = len(t.start)
        own, back1, back2, ahead = (t.shape @ self.w[k] for k in range(4))
        e = own[t.which] + (t.file @ self.file)[t.row]
        chain = np.zeros(n, np.int64)
        chain[t.chain] = 1
        chain = np.cumsum(chain)
        for part, by in ((back1, 1), (back2, 2)):
            e[by:] += part[t.which[:-by]] * (chain[by:] == chain[:-by])[:, None]
        e[:-1] += ahead[t.which[1:]] * (chain[1:] == chain[:-1])[:, None]
        return e

    def decode(self, t: Tokens) -> np.ndarray:
        """Best tag of every token, by Viterbi in all chains at once."""
        n = len(t.start)
        tags = np.zeros(n, np.uint8)
        if not n:
            return tags
        e = self.scores(t)
        # What a token can gain at most over "outside", transitions in and out included.
        steps = max(0.0, float((self.move[:, [B, I]] - self.move[O, O]).max()), float((self.start[[B, I]] - self.start[O]).max()))
        steps += max(0.0, float((self.move[[B, I], O] - self.move[O, O]).max()))
        gain = np.maximum(e[:, B], e[:, I]) - e[:, O] + steps > 0
        size = np.diff(np.append(t.chain, n))
        doubt = np.flatnonzero(np.add.reduceat(gain.astype(np.int64), t.chain) > 0)
        order = doubt[np.argsort(-size[doubt], kind="stable")]
        first, size = t.chain[order], size[order]
        if not len(order):
            return tags
        came = np.zeros((n, 3), np.uint8)
        best = e[first] + self.start
        last = best.copy()
        for k in range(1, size[0]):
            live = np.searchsorted(-size, -k, "left")
            through = best[:live, :, None] + self.move[None]
            came[first[:live] + k] = through.argmax(axis=1)
            best = through.max(axis=1) + e[first[:live] + k]
            last[:live] = best
        tag = last.argmax(axis=1)
        for k in range(size[0] - 1, -1, -1):
            live = np.searchsorted(-size, -k, "left")
            at_k = first[:live] + k
            tags[at_k] = tag[:live]
            tag[:live] = came[at_k, tag[:live]]
        return tags


def made_lines(seed: int = 11) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines with invented keys of makes that the patterns do not name, and the same lines without one."""
    rng = np.random.default_rng(seed)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    forms = ("Authorization: Bearer {}", "client_key: {}", 'private_key = "{}"', "auth={}", "credentials: '{}'", "access key {} is set", "pwd: {}")
    out = []
    for k in range(MADE):
        form = forms[k % len(forms)]
        if k % 3 == 2:
            word = "".join(rng.choice(letters[26:52], int(rng.integers(3, 14))))
            out.append((form.format(word), []))
        else:
            key = "".join(rng.choice(letters, int(rng.integers(20, 48))))
            i = form.index("{}")
            out.append((form.format(key), [(i, i + len(key))]))
    return out + [(x, []) for x in plain_lines(rng, MADE)]


def plain_lines(rng: np.random.Generator, n: int) -> list[str]:
    """Lines with what looks like a key and is none: numbers, dates, identifiers, short hashes, addresses."""
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz0123456789"))
    digits = lambda a, b: "".join(rng.choice(letters[26:], int(rng.integers(a, b))))
    word = lambda a, b: "".join(rng.choice(letters[:26], int(rng.integers(a, b))))
    mixed = lambda a, b: "".join(rng.choice(letters, int(rng.integers(a, b))))
    forms = (
        lambda: f"call {digits(3, 4)}-{digits(3, 4)}-{digits(4, 5)} or {digits(9, 14)} today", lambda: f"order number {digits(6, 20)} was sent",
        lambda: f"the total was {digits(5, 12)} in {digits(4, 5)}", lambda: f"see https://{word(4, 9)}.org/{word(3, 9)}/{mixed(8, 30)} for more", lambda: f"commit {mixed(7, 12)} by {word(3, 8)}",
        lambda: f"{word(4, 9)} {mixed(8, 9)}-{mixed(4, 5)}-{mixed(4, 5)}-{mixed(4, 5)}-{mixed(12, 13)}", lambda: f"mail {word(3, 8)}.{word(3, 8)}{digits(1, 4)}@{word(4, 9)}.com",
        lambda: f"id={digits(4, 12)} page={digits(1, 4)}", lambda: f"card {digits(4, 5)} {digits(4, 5)} {digits(4, 5)} {digits(4, 5)}", lambda: f"{word(3, 9)}_{word(3, 9)}_{digits(2, 6)} = {digits(1, 9)}",
        lambda: f"host {digits(1, 4)}.{digits(1, 4)}.{digits(1, 4)}.{digits(1, 4)} at 20{digits(2, 3)}-{digits(2, 3)}-{digits(2, 3)}T{digits(2, 3)}:{digits(2, 3)}", lambda: f"{digits(10, 30)}",
    )
    return [forms[k % len(forms)]() for k in range(n)]


def secret_parts(text: str) -> list[tuple[int, int]]:
    """Where the secret itself stands: the value of an assignment, a whole key otherwise."""
    out = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    return out + [s[:2] for s in base_spans(text, ("access", "hex"))]


def snippets(text: str, salt: int) -> list[str]:
    """Short stretches to learn from: around up to four secrets, and up to two others chosen by the salt."""
    cut = lambda i: text[max(0, i - SNIPPET // 2) : i + SNIPPET // 2]
    out = [cut(i) for i, _ in secret_parts(text)[:4]]
    return out + [cut(salt * (k + 1) * 2654435761 % max(1, len(text))) for k in range(2)]


def fit(lines: list[tuple[str, list[tuple[int, int]]]], rounds: int = 120, rate: float = 0.2, decay: float = 1e-4) -> Field:
    """Maximum likelihood with a quadratic penalty, by Adam over forward-backward gradients."""
    ascii_lines = [("".join(c if ord(c) < 128 else "é" for c in s), spans) for s, spans in lines]
    t = Tokens(pa.array([s for s, _ in ascii_lines], pa.string()))
    n = len(t.start)
    place = np.cumsum((t.data & 0xC0) != 0x80) - 1  # code point of each byte, over all lines
    line_at = np.cumsum([0] + [len(s) for s, _ in ascii_lines])
    tag = np.zeros(n, np.int64)
    begin = place[t.start] - line_at[t.row]
    end = place[t.stop - 1] - line_at[t.row] + 1
    by_line = at.bounds(t.row, len(lines))
    for k, (_, spans) in enumerate(ascii_lines):
        for i, j in spans:
            own = np.arange(by_line[k], by_line[k + 1])
            hit = own[(begin[own] < j) & (end[own] > i)]
            tag[hit[:1]], tag[hit[1:]] = B, I
    size = np.minimum(np.diff(np.append(t.chain, n)), CHAIN)
    chain = np.repeat(np.arange(len(size)), np.diff(np.append(t.chain, n)))
    # All chains with a secret, and the others up to a bound, longest first.
    wanted = np.flatnonzero(np.add.reduceat(tag, t.chain) > 0)
    other = np.setdiff1d(np.arange(len(size)), wanted)
    wanted = np.concatenate([wanted, np.random.default_rng(3).permutation(other)[:PLAIN_CHAINS]])
    wanted = wanted[np.argsort(-size[wanted], kind="stable")]
    first, size = t.chain[wanted], size[wanted]
    live = [int(np.searchsorted(-size, -k, "left")) for k in range(int(size[0]))]
    places = [first[:m] + k for k, m in enumerate(live)]
    used = np.concatenate(places)
    shape = t.shape[t.which]
    shift = lambda by: np.where((chain == np.roll(chain, by))[:, None], np.roll(shape, by, axis=0), 0)
    x = np.concatenate([shape, shift(1), shift(2), shift(-1), t.file[t.row]], axis=1)[used]
    edge = np.concatenate([[0], np.cumsum(live)])
    tag = tag[used]
    theta = {"x": np.zeros((x.shape[1], 3)), "move": np.zeros((3, 3)), "start": np.zeros(3)}
    never = np.zeros((3, 3))
    never[O, I] = -1e4
    first_never = np.array([0, 0, -1e4])
    gold = np.zeros((len(used), 3))
    gold[np.arange(len(used)), tag] = 1
    at_step = lambda a, k: a[edge[k] : edge[k + 1]]
    gold_move = np.zeros((3, 3))
    for k in range(1, len(live)):
        np.add.at(gold_move, (at_step(tag, k - 1)[: live[k]], at_step(tag, k)), 1)
    gold_start = np.bincount(at_step(tag, 0), minlength=3).astype(float)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in theta.items()}
    lse = lambda a, axis: (top := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - top).sum(axis=axis))
    for r in range(1, rounds + 1):
        e = x @ theta["x"]
        move, start = theta["move"] + never, theta["start"] + first_never
        f = [start + at_step(e, 0)]
        z = f[0].copy()
        for k in range(1, len(live)):
            f.append(lse(f[-1][: live[k], :, None] + move[None], 1) + at_step(e, k))
            z[: live[k]] = f[-1]
        z = lse(z, 1)
        b = np.zeros((0, 3))
        expect_move = np.zeros((3, 3))
        post = np.zeros((len(used), 3))
        for k in range(len(live) - 1, -1, -1):
            b = np.concatenate([b, np.zeros((live[k] - len(b), 3))])
            post[edge[k] : edge[k + 1]] = np.exp(f[k] + b - z[: live[k], None])
            if k:
                inner = move[None] + (at_step(e, k) + b)[:, None, :]
                expect_move += np.exp(f[k - 1][: live[k], :, None] + inner - z[: live[k], None, None]).sum(axis=0)
                b = lse(inner, 2)
        grad = {"x": x.T @ (post - gold), "move": expect_move - gold_move, "start": at_step(post, 0).sum(axis=0) - gold_start}
        for k, v in theta.items():
            g = grad[k] / len(size) + decay * v
            one, two = moments[k]
            one += 0.1 * (g - one)
            two += 0.01 * (g * g - two)
            v -= rate * (one / (1 - 0.9**r)) / (np.sqrt(two / (1 - 0.99**r)) + 1e-8)
    w = theta["x"].astype(np.float32)
    return Field(w[: 4 * SHAPES].reshape(4, SHAPES, 3), w[4 * SHAPES :], (theta["move"] + never).astype(np.float32), (theta["start"] + first_never).astype(np.float32))


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def train(texts: DataFrame, train_docs: int = TRAIN_DOCS) -> Field:
    """Fit the field on at most train_docs documents (and those that tie with the last of them by hash)."""
    salt = F.xxhash64(F.lit(5), "doc_id")
    edge = texts.select(salt.alias("h")).orderBy("h").limit(train_docs).agg(F.max("h")).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = [s for t, h in zip(part.column("text").to_pylist(), part.column("h").to_pylist()) if t for s in snippets(t, h)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["s"])

    lines = made_lines()
    if edge is not None:
        rows = texts.select("text", salt.alias("h")).filter(F.col("h") <= edge).mapInArrow(run, "s string").distinct().collect()
        found = sorted(r.s for r in rows)
        lines += [(s, secret_parts(s)) for s in found]
    return fit(lines)


def all_spans(texts: pa.Array, field: Field, least: float = float("-inf")) -> list[tuple[list, list]]:
    """(pattern matches, all spans) of each text; tagged spans have log-odds of `least` or more at their beginning."""
    n = len(texts)
    strings = texts.cast(pa.large_string())
    maybe = {k: pc.fill_null(pc.match_substring_regex(strings, p), False).to_numpy(zero_copy_only=False) for k, p in MAYBE.items()}
    t = Tokens(texts)
    tags = field.decode(t)
    begin = np.flatnonzero((tags == B) | ((tags == I) & (np.concatenate([[O], tags[:-1]]) == O)))
    if len(begin) and least > float("-inf"):
        e = field.scores(t)[begin]
        begin = begin[e[:, B] - e[:, O] >= least]
    edge = np.searchsorted(t.row[begin], np.arange(n + 1)) if len(begin) else np.zeros(n + 1, np.int64)
    out = []
    for k in range(n):
        kinds = [x for x in maybe if maybe[x][k]]
        base = base_spans(texts[k].as_py(), kinds) if kinds else []
        more = []
        if edge[k + 1] > edge[k]:
            own = t.data[t.offsets[k] : t.offsets[k + 1]]
            place = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
            for i in begin[edge[k] : edge[k + 1]]:
                j = i
                while j + 1 < len(tags) and tags[j + 1] == I and t.row[j + 1] == k:
                    j += 1
                a, b = int(place[t.start[i] - t.offsets[k]]), int(place[t.stop[j] - t.offsets[k]])
                if all(b <= x or a >= y for x, y, _ in base):
                    more.append((a, b, "crf"))
        out.append((base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))))
    return out


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, base, spans, n_assign, n_access, n_hex for every row; base and spans are comma-joined kind:start:end."""
    texts = texts_of(docs, id_col, text_col)
    field = docs.sparkSession.sparkContext.broadcast(train(texts, train_docs))
    say = lambda spans: ",".join(f"{k}:{i}:{j}" for i, j, k in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in at.slices(batches, "text", SLICE):
            found = all_spans(part.column("text"), field.value)
            count = lambda kind: pa.array([sum(s[2] == kind for s in b) for b, _ in found], pa.int64())
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "base": pa.array([say(b) for b, _ in found], pa.string()),
                "spans": pa.array([say(s) for _, s in found], pa.string()),
                "n_assign": count("assign"), "n_access": count("access"), "n_hex": count("hex"),
            })

    kind = dict(texts.dtypes)["doc_id"]
    return texts.mapInArrow(run, f"doc_id {kind}, base string, spans string, n_assign long, n_access long, n_hex long")


def redact(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", train_docs: int = TRAIN_DOCS, least: float = SURE,
) -> DataFrame:
    """All columns of `docs`, with every pattern match and every tagged span of log-odds `least` or more replaced by `mark`."""
    field = docs.sparkSession.sparkContext.broadcast(train(texts_of(docs, id_col, text_col), train_docs))

    def clean(text: str, spans: list) -> str:
        out, last = [], 0
        for i, j, _ in spans:
            if i >= last:
                out += [text[last:i], mark]
            last = max(last, j)
        return "".join([*out, text[last:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in at.slices(batches, text_col, SLICE):
            column = part.column(text_col)
            found = all_spans(column.cast(pa.string()), field.value, least)
            new = [clean(x.as_py(), s) if s else x.as_py() for x, (_, s) in zip(column, found)]
            yield part.set_column(part.schema.get_field_index(text_col), text_col, pa.array(new, pa.string()))

    return docs.mapInArrow(run, docs.schema)
