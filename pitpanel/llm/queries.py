"""One registered query per operator, with the SQL that checks it where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pitpanel.llm.bin_packing import packed
from pitpanel.llm.decontaminate import contamination
from pitpanel.llm.language_id import languages
from pitpanel.llm.license_digests import WHOLE
from pitpanel.llm.license_scan import COPYRIGHT, KNOWN, OTHER, SPELLINGS, license_scan
from pitpanel.llm.lm_score import scores
from pitpanel.llm.merkle_manifest import fold, hexed, manifest, row_digest, siblings_hex
from pitpanel.llm.near_dedup import near_duplicates
from pitpanel.llm.periodic_runs import periodic_runs
from pitpanel.llm.piece_spans import encoded
from pitpanel.llm.quality_ledger import BIT, MEASURES, POLICIES, ablation, judged, ledger, mask
from pitpanel.llm.secret_tags import secrets
from pitpanel.llm.token_matrix import packed_shards
from pitpanel.llm.warc_derivatives import derivatives

QUERIES: dict = {}
SQL: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
WORDS = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col, folds: int):
    """True where the checksum of the id as text divides by `folds`."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


OP3_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWERED}, '{WORDS}') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT w.doc_id, count(s) AS n FROM w LEFT JOIN sh USING (doc_id) GROUP BY 1
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)
), reach AS (
  SELECT doc_id AS id, doc_id AS r FROM n
  UNION
  SELECT reach.id, link.b FROM reach JOIN link ON reach.r = link.a
)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept
FROM n JOIN (SELECT id, min(r) AS component_id FROM reach GROUP BY 1) c ON c.id = n.doc_id
"""


@query("op3_minhash_near_dedup", OP3_SQL)
def op3(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), width=5, percent=85)


OP10_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w,
         [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
  FROM documents
), p AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM t WHERE len(w) >= 3)
), r AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM p) WHERE n > 1
  ) GROUP BY 1
), m AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN r USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (word_chars < 2 * n_words)::BIGINT
          + 8 * (word_chars > 20 * n_words)::BIGINT + 16 * (n_symbols > n_words)::BIGINT
          + 32 * (100 * n_dup_lines > 50 * n_lines)::BIGINT)::BIGINT AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits, base_failed, fail_bits = 0 AS kept FROM b
"""


@query("op10_quality_rules", OP10_SQL)
def op10(spark, sf_dir):
    rows = judged(ledger(table(spark, sf_dir, "documents")), 2)
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(1)).cast("long")) != 0
    return rows.select("doc_id", *MEASURES, "fail_bits", base.alias("base_failed"), "kept")


@query("quality_rule_ablation", f"""
WITH q AS ({OP10_SQL}), v AS (SELECT * FROM (VALUES {", ".join(f"('{r}', {BIT[r]}::BIGINT)" for r in POLICIES[2])}) AS v(rule, bit))
SELECT rule, count(*) FILTER (WHERE fail_bits & bit <> 0) AS n_failed, count(*) FILTER (WHERE fail_bits = bit) AS n_only,
       count(*) FILTER (WHERE fail_bits = 0) AS n_kept, count(*) FILTER (WHERE fail_bits = 0 OR fail_bits = bit) AS n_kept_without
FROM q, v GROUP BY rule""")
def quality_rule_ablation(spark, sf_dir):
    """What each rule of the policy drops, alone and with others, from the counts of failure patterns."""
    return ablation(ledger(table(spark, sf_dir, "documents")), 2)


OP4_WORDS = r"[0-9a-z\x{80}-\x{10FFFF}]+"

OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({LOWERED}, '{OP4_WORDS}') AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all({LOWERED}, '{OP4_WORDS}') AS w FROM benchmark WHERE item_id IS NOT NULL
), p AS (
  SELECT DISTINCT item, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)
), lengths AS (
  SELECT DISTINCT m FROM p
), v AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, lengths WHERE len(w) >= m)
), hit AS (
  SELECT v.doc_id, v.i, v.m, p.item FROM v JOIN p ON v.s = p.s AND v.m = p.m
), n AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + m - 1)) AS k FROM hit) GROUP BY 1
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query("op4_benchmark_decontamination", OP4_SQL)
def op4(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@query("op8_best_fit_packing")
def op8(spark, sf_dir):
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


@query("op9_secret_scan")
def op9(spark, sf_dir):
    found = secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


@query("op2_language_id")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"), 5)
    found = languages(docs, learn_from=~held)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query("op5_lm_scoring")
def op5(spark, sf_dir):
    held = held_out(F.col("doc_id"), 10)
    found = scores(table(spark, sf_dir, "documents"), learn_from=~held)
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op6_warc_derivatives")
def op6(spark, sf_dir):
    return derivatives(table(spark, sf_dir, "pages")).drop("header")


@query("op7_token_matrix")
def op7(spark, sf_dir):
    import public_tokenizers

    found = packed_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)
    return found.select("shard", "n_rows", "n_pieces", "n_tokens", *[F.crc32(c).alias(f"{c}_crc32") for c in ("ids", "positions", "cu_seqlens")])


def canonical_sql(line: str) -> str:
    low = f"translate({line}, '{UPPER}', '{LOWER}')"
    out = f"' ' || regexp_replace({low}, '{OTHER}', '  ', 'g') || ' '"
    for odd, usual in SPELLINGS:
        out = f"replace({out}, ' {odd} ', ' {usual} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g')) AS c, regexp_matches({low}, '{COPYRIGHT}') AS holder"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


OP1_OTHER = OTHER.replace(r"\x80", r"\x{80}")
OP1_LINES = "unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i"
#: The same two lists of texts and of digests that the query joins with.
OP1_SQL = rf"""
WITH known AS (
  SELECT license, {canonical_sql('line')}, i, k
  FROM (SELECT license, k, {OP1_LINES} FROM (VALUES {', '.join(f"({quoted(k)}, {n}, {quoted(t)})" for n, (k, t) in enumerate((k, t) for k, v in KNOWN.items() for t in v))}) AS v(license, k, text))
), names AS (
  SELECT license, sha256(string_agg(c, ' ' ORDER BY i)) AS digest FROM known WHERE c <> '' AND NOT holder GROUP BY license, k
  UNION
  SELECT license, digest FROM (VALUES {', '.join(f"({quoted(k)}, '{d}')" for k, v in WHOLE.items() for d in v)}) AS w(license, digest)
), l AS (
  SELECT doc_id, i, {canonical_sql('line')} FROM (SELECT doc_id, {OP1_LINES} FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))
), d AS (
  SELECT doc_id, sha256(coalesce(string_agg(c, ' ' ORDER BY i) FILTER (WHERE c <> '' AND NOT holder), '')) AS text_digest,
         sha256(coalesce(string_agg(c, ' ' ORDER BY i) FILTER (WHERE c <> ''), '')) AS every_digest FROM l GROUP BY 1
), hit AS (
  SELECT doc_id, license, false AS whole FROM l JOIN names ON sha256(c) = digest WHERE c <> '' AND NOT holder
  UNION ALL
  SELECT doc_id, license, true FROM d JOIN names ON digest IN (text_digest, every_digest)
), h AS (
  SELECT doc_id, count(*) FILTER (WHERE NOT whole) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
         string_agg(DISTINCT license, ',' ORDER BY license) FILTER (WHERE whole) AS w FROM hit GROUP BY 1
)
SELECT d.doc_id, d.text_digest, h.w AS whole_license, coalesce(h.n, 0)::BIGINT AS n_license_lines, coalesce(h.licenses, '') AS licenses
FROM d LEFT JOIN h USING (doc_id)
""".replace(OTHER, OP1_OTHER)


@query("op1_license_scan", OP1_SQL)
def op1(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))


def leaf_sql(text: str) -> str:
    parts = [f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return "sha256(" + " || ".join(parts) + ")"


#: The checksum of an id is taken bit by bit, eight steps a character.
OP12_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT doc_id::VARCHAR AS s, 0 AS k, 4294967295::BIGINT AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT s, k + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END
  FROM (SELECT s, k, CASE WHEN k % 8 = 0 THEN xor(c, ascii(substr(s, k // 8 + 1, 1))::BIGINT) ELSE c END AS x FROM crc WHERE k < 8 * strlen(s))
), d AS (
  SELECT doc_id, source, {leaf_sql('text')} AS leaf, {leaf_sql("replace(text, chr(10), '')")} AS bad,
         doc_id::VARCHAR IN (SELECT s FROM crc WHERE k = 8 * strlen(s) AND c % 2 = 1) AS tampered
  FROM documents
), src AS (
  SELECT source, count(*) AS n, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM documents GROUP BY source
), leafs AS (
  SELECT d.*, src.tree, src.n, row_number() OVER (PARTITION BY src.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
  FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source
), lv AS (
  SELECT tree, 0 AS l, i, n, leaf AS h FROM leafs
  UNION ALL
  SELECT tree, l + 1, i // 3, max((n + 2) // 3), sha256(string_agg(h, '' ORDER BY i)) FROM lv WHERE n > 1 GROUP BY tree, l, i // 3
), tops AS (
  SELECT 0 AS l, tree AS i, (SELECT count(*) FROM src) AS n, h FROM lv WHERE n = 1
  UNION ALL
  SELECT l + 1, i // 3, max((n + 2) // 3), sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY l, i // 3
), nodes AS (
  SELECT tree, l, i, h FROM lv WHERE n > 1 UNION ALL SELECT -1, l, i, h FROM tops WHERE n > 1
), sib AS (
  SELECT tree, l, i, array_to_string(g[1:i % 3], '') AS le, array_to_string(g[i % 3 + 2:], '') AS ri
  FROM (SELECT tree, l, i, list(h) OVER (PARTITION BY tree, l, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS g FROM nodes)
), f AS (
  SELECT row_number() OVER () AS id, tree AS own, tree, 0 AS l, i, CASE WHEN tampered THEN bad ELSE leaf END AS h, '' AS proof, n FROM leafs
  UNION ALL
  SELECT id, own, CASE WHEN f.n = 1 THEN -1 ELSE f.tree END, CASE WHEN f.n = 1 THEN 0 ELSE f.l + 1 END,
         CASE WHEN f.n = 1 THEN f.tree ELSE f.i // 3 END, CASE WHEN f.n = 1 THEN f.h ELSE sha256(sib.le || f.h || sib.ri) END,
         CASE WHEN f.n = 1 THEN proof ELSE proof || sib.le || sib.ri END, CASE WHEN f.n = 1 THEN (SELECT count(*) FROM src) ELSE (f.n + 2) // 3 END
  FROM f LEFT JOIN sib ON f.n > 1 AND sib.tree = f.tree AND sib.l = f.l AND sib.i = f.i WHERE NOT (f.tree = -1 AND f.n = 1)
), done AS (
  SELECT id, h AS folded_root, proof FROM f WHERE tree = -1 AND n = 1
), named AS (
  SELECT row_number() OVER () AS id, doc_id, leaf, tree FROM leafs
)
SELECT doc_id, leaf, lv.h AS subroot, tops.h AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = tops.h AS verified
FROM named JOIN done USING (id) JOIN lv ON lv.tree = named.tree AND lv.n = 1 JOIN tops ON tops.n = 1
"""


@query("op12_merkle_manifest", OP12_SQL)
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    bad = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, row_digest(*columns, F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    leaf = row_digest(*columns, F.col("text"))
    found = manifest(docs, leaf, F.col("source"), F.col("doc_id"), {"doc_id": F.col("doc_id"), "tampered": F.coalesce(bad, leaf)}, arity=3)
    rows = found.select(
        "doc_id", hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"),
        F.sha2(siblings_hex(F.col("path")).cast("binary"), 256).alias("proof_sha256"), fold(hexed(F.col("tampered")), F.col("path")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op13_piece_spans")
def op13(spark, sf_dir):
    import public_tokenizers

    rows = encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), decode=True)
    return rows.select(
        "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.sha2(F.concat("begins", "ends"), 256).alias("spans_sha256"),
    )


@query("op11_periodic_runs")
def op11(spark, sf_dir):
    """A tenth of the documents, by checksum of the id, is made periodic from some word on before runs are looked for."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    made = docs.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
    made = made.withColumn("n", F.size("w").cast("long")).withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("if(n > 0, g % n, null)"))
    made = made.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = "slice(flatten(array_repeat(slice(w, cast(a + 1 as int), cast(p as int)), cast((n - a + p - 1) div p as int))), 1, cast(n - a as int))"
    periodic = F.expr(f"if(a is null, text, array_join(concat(slice(w, 1, cast(a as int)), {tail}), ' '))")
    found = periodic_runs(made.select("doc_id", periodic.alias("text")))
    most = F.expr("aggregate(runs, runs[0], (b, r) -> if(r.length * b.period > b.length * r.period, r, b))")
    rows = found.withColumn("best", F.when(F.size("runs") > 0, most))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
