"""The registered queries of this package: thin views of its operators over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skyloom.llm import bm25, chosen_path, frame_files, hash_tree, license_scan, merkle, packing, rlz, spm, toxicity
from skyloom.llm.common import load

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = hash_tree.HashTree.balanced(regions=4, racks=5, shards=2)
    return hash_tree.shard_report(load(spark, sf_dir, "documents"), tree)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_files.token_report(load(spark, sf_dir, "documents"), BYTE_BPE, end_id=2)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.dedup(load(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


def op4_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return bm25.search(docs, docs.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"), k=10)


def op5_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_report(load(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.link_classes(load(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(load(spark, sf_dir, "documents"), license_scan.TEMPLATES)
    return found.select("doc_id", "license", "containment", "first_word")


def op8_short_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices of fewer words than a shingle, which the oracle of op8_license_scan has no shingles for."""
    found = license_scan.scan(load(spark, sf_dir, "documents"), license_scan.SHORT_NOTICES)
    return found.select("doc_id", "license", "containment", "first_word")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), WORD_BPE, end_id=0, capacity=2048)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.report(load(spark, sf_dir, "documents"), PIECE_BPE)


def queries() -> dict:
    return {
        "op1_hash_tree": op1_hash_tree,
        "op2_token_files": op2_token_files,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_bm25_search": op4_bm25_search,
        "op5_merkle_fingerprints": op5_merkle_fingerprints,
        "op6_ngram_join": op6_ngram_join,
        "op7_toxicity": op7_toxicity,
        "op8_license_scan": op8_license_scan,
        "op8_short_notices": op8_short_notices,
        "op9_packing": op9_packing,
        "op10_sentencepiece": op10_sentencepiece,
    }


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Every window against all windows.
OP3_SQL = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20),
k AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 19], ' ')) AS h FROM p),
f AS (SELECT doc_id, s, min(doc_id::HUGEINT * 4294967296 + s) OVER (PARTITION BY h) AS first FROM k),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM f WHERE doc_id::HUGEINT * 4294967296 + s > first),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
y AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) FILTER (c.i IS NULL) AS kept, count(c.i) AS gone
  FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY x.doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN y ON w.doc_id = y.doc_id
"""

#: Scores of all documents for all queries.
OP4_SQL = f"""
WITH w AS (SELECT doc_id, unnest({WORDS}) AS t FROM documents),
l AS (SELECT doc_id, len({WORDS}) AS n FROM documents),
m AS (SELECT count(*) AS docs, sum(n) / count(*) AS mean FROM l),
f AS (SELECT doc_id, t, count(*) AS tf FROM w GROUP BY ALL),
i AS (SELECT t, ln(1 + (docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM f, m GROUP BY t, docs),
x AS (SELECT doc_id, t, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)) AS part
  FROM f JOIN l USING (doc_id) JOIN i USING (t), m),
s AS (SELECT q.doc_id AS query_id, x.doc_id, round(sum(part), 6) AS score
  FROM f q JOIN x ON q.t = x.t WHERE q.doc_id % 50 = 0 GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM s QUALIFY rank <= 10
"""

#: Marks where pieces end, cuts there, and hashes upwards.
_TREE = f"""list_transform(string_split({{0}}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)),
  lambda p: list_transform(list_filter(string_split(regexp_replace(regexp_replace(p, '([{merkle.ENDS}])([ \\t])', '\\1' || chr(1) || '\\2', 'g'),
    '([{merkle.MARKS}])', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''), lambda x: md5(x))))"""
_TREE = _TREE.replace("\\\\", "\\")
_HASHED = """list_transform({0}, lambda s: {{'h': md5(array_to_string(list_transform(s, lambda p: md5(array_to_string(p, ''))), '')),
  'p': array_to_string(list_transform(s, lambda p: left(md5(array_to_string(p, '')), 8) ||
    CASE WHEN len(p) > 0 THEN '.' ELSE '' END || array_to_string(list_transform(p, lambda m: left(m, 8)), ',')), ';')}})"""
_PRINT = """md5(array_to_string(list_transform({0}, lambda s: s.h), '')) || '|' ||
  array_to_string(list_transform({0}, lambda s: left(s.h, 10) || ':' || s.p), '|')"""
_PIECES = "coalesce(list_sum(list_transform({0}, lambda x: length(x) - length(translate(x, '.,', '')))), 0)"


def _walk_sql(a: str, b: str) -> str:
    """Likeness of two fingerprints, one level after another."""
    return f"""SELECT doc_id, CASE WHEN {a} = {b} THEN 1.0 ELSE 2.0 * (
    {_PIECES.format("list_filter(x, lambda n: list_contains(y, n))")} + {_PIECES.format("list_filter(p, lambda n: list_contains(q, n))")} +
    len(list_intersect(list_distinct(flatten(list_transform(list_filter(p, lambda n: NOT list_contains(q, n) AND length(n) > 8), lambda n: string_split(n[10:], ',')))),
      list_distinct(flatten(list_transform(list_filter(q, lambda n: NOT list_contains(p, n) AND length(n) > 8), lambda n: string_split(n[10:], ',')))))))
    / greatest({_PIECES.format("x")} + {_PIECES.format("y")}, 1) END AS near
  FROM (SELECT *, list_distinct(flatten(list_transform(list_filter(x, lambda n: NOT list_contains(y, n)), lambda n: string_split(n[12:], ';')))) AS p,
      list_distinct(flatten(list_transform(list_filter(y, lambda n: NOT list_contains(x, n)), lambda n: string_split(n[12:], ';')))) AS q
    FROM (SELECT *, list_distinct(string_split({a}[34:], '|')) AS x, list_distinct(string_split({b}[34:], '|')) AS y FROM f))"""


OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next FROM d),
e AS (SELECT *, left(text, length(text) - length(text) // 4) || left(next, length(text) // 4) AS edited FROM n),
t AS (SELECT *, {_HASHED.format(_TREE.format("text"))} AS a, {_HASHED.format(_TREE.format("edited"))} AS b,
  {_HASHED.format(_TREE.format("next"))} AS c FROM e),
f AS (SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, {_PRINT.format("a")} AS fingerprint,
  {_PRINT.format("b")} AS edited_fingerprint, {_PRINT.format("c")} AS next_fingerprint FROM t)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, u.near::DOUBLE AS near_edited, v.near::DOUBLE AS near_next
FROM f JOIN ({_walk_sql("fingerprint", "edited_fingerprint")}) u USING (doc_id)
JOIN ({_walk_sql("fingerprint", "next_fingerprint")}) v USING (doc_id)
"""

#: All pairs of different shingle sets with a common shingle.
OP6_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, h FROM (SELECT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0))),
g AS (SELECT doc_id, md5(string_agg(h, ',' ORDER BY h)) AS sig, count(*) AS n FROM s GROUP BY doc_id),
m AS (SELECT doc_id, sig, n, min(doc_id) OVER (PARTITION BY sig) AS rep_id FROM g),
r AS (SELECT s.* FROM s JOIN m ON s.doc_id = m.doc_id WHERE m.rep_id = m.doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM r a JOIN r b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN m x ON x.doc_id = a JOIN m y ON y.doc_id = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
t AS (SELECT a, b FROM l UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a),
k AS (SELECT a, least(a, min(b)) AS class_id FROM t GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT w.doc_id, coalesce(rep_id, w.doc_id) AS rep_id, coalesce(class_id, rep_id, w.doc_id) AS class_id, coalesce(n_links, 0) AS n_links
FROM w LEFT JOIN m ON w.doc_id = m.doc_id LEFT JOIN k ON rep_id = k.a LEFT JOIN n ON rep_id = n.a
"""

_TEMPLATES = ", ".join(
    "('" + name + "', [" + ", ".join(f"'{w}'" for w in license_scan.template_words(text)) + "])"
    for name, text in license_scan.TEMPLATES.items()
)
_SUPERSEDED = ", ".join(f"('{a}', '{b}')" for a, b in license_scan.superseded(license_scan.TEMPLATES))
#: Containment of every template in every text; of a match and a longer one that it stands in, the longer.
OP8_SQL = rf"""
WITH t AS (SELECT DISTINCT license, array_to_string(ws[i:i + 4], ' ') AS h
  FROM (SELECT license, ws, unnest(range(1, len(ws) - 3)) AS i FROM (VALUES {_TEMPLATES}) v(license, ws))),
n AS (SELECT license, count(*) AS n FROM t GROUP BY license),
w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS ws FROM documents),
s AS (SELECT doc_id, i - 1 AS place, array_to_string(ws[i:i + 4], ' ') AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
f AS (SELECT doc_id, license, count(DISTINCT h) AS c, min(place) AS first_word FROM s JOIN t USING (h) GROUP BY ALL),
m AS (SELECT doc_id, license, round(c::DOUBLE / n, 6) AS containment, first_word FROM f JOIN n USING (license) WHERE c::DOUBLE / n >= 0.8)
SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m o JOIN (VALUES {_SUPERSEDED}) p(a, b) ON o.license = p.b
  WHERE o.doc_id = m.doc_id AND m.license = p.a)
"""

_SHORT = ", ".join(
    f"('{name}', ' {' '.join(license_scan.template_words(text))} ')" for name, text in license_scan.SHORT_NOTICES.items()
)
#: The notice's words in the text's words, in a row.
OP8_SHORT_SQL = rf"""
WITH t AS (SELECT * FROM (VALUES {_SHORT}) v(license, whole)),
w AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), ' ') || ' ' AS line FROM documents),
f AS (SELECT doc_id, license, len(string_split(left(line, strpos(line, whole)), ' ')) - 2 AS place FROM w, t WHERE contains(line, whole))
SELECT doc_id, license, 1.0::DOUBLE AS containment, min(place) AS first_word FROM f GROUP BY ALL
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_substring_dedup": OP3_SQL,
        "op4_bm25_search": OP4_SQL,
        "op5_merkle_fingerprints": OP5_SQL,
        "op6_ngram_join": OP6_SQL,
        "op8_license_scan": OP8_SQL,
        "op8_short_notices": OP8_SHORT_SQL,
    }
