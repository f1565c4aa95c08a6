"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.llm import decontamination, hidden_markov, language_id, main_text, merkle, ngram_join, packing, pseudonyms, secret_scan, spelling, token_file, vector_search, word_bpe
from sketchloom.llm.staging import table


def op1_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = vector_search.top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 50 == 0, k=5)
    return best.withColumnRenamed("id", "vec_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of documents, then rows of pages with page_id instead of doc_id: each table has models and sums of its own."""
    docs = language_id.identify_documents(table(spark, sf_dir, "documents")).withColumn("page_id", F.lit(None).cast("long"))
    pages = language_id.identify_pages(table(spark, sf_dir, "pages")).withColumn("page_id", F.col("doc_id")).withColumn("doc_id", F.lit(None).cast("long"))
    return docs.unionByName(pages)


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymize(table(spark, sf_dir, "documents"), key=pseudonyms.session_key(spark))


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_file.write_token_file(table(spark, sf_dir, "documents"), token_file.new_path(spark), end_id=2)
    return token_file.read_token_file(spark, path)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), size=2048, end_id=1)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), n=5)


def op9_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.score(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(table(spark, sf_dir, "documents"))


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.digests(word_bpe.encode(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_vector_search": op1_vector_search,
    "op2_language_id": op2_language_id,
    "op3_pseudonyms": op3_pseudonyms,
    "op4_token_file": op4_token_file,
    "op5_secret_scan": op5_secret_scan,
    "op6_packing": op6_packing,
    "op7_main_text": op7_main_text,
    "op8_ngram_join": op8_ngram_join,
    "op9_hidden_markov": op9_hidden_markov,
    "op10_decontamination": op10_decontamination,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_word_bpe": op13_word_bpe,
}
ORACLES: dict[str, str] = {
    "op1_vector_search": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.x) = len(q.x)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5""",
    "op8_ngram_join": """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * common >= 75 * (p.n + q.n - common)),
t AS (SELECT a, b FROM l UNION SELECT t.a, l.b FROM t JOIN l ON l.a = t.b)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, least(d.doc_id, min(t.b)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.a = d.doc_id GROUP BY d.doc_id""",
}

# CRC-32 of a text in SQL: the table of its remainders by bytes, then a step for each byte in UTF-8
_CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t)"""


def _crc32(text: str) -> str:
    code = f"list_transform(range(octet_length(encode({text}))), lambda k: ('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {code}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"


def _tree_sql(name: str, levels: int) -> str:
    """CTEs over {name}0(part, pos, h, n): the levels above, and for each node the text left and right of it in its run."""
    out = []
    for k in range(levels):
        a = f"{name}{k}"
        out.append(f"""{name}{k + 1} AS (SELECT part, pos // 8 AS pos, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h, CASE WHEN n > 1 THEN (n + 7) // 8 ELSE 1 END AS n
  FROM {a} GROUP BY part, pos // 8, n)""")
        out.append(f"""{name}_s{k} AS (SELECT x.part, x.pos, x.n, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS l, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS r
  FROM {a} x JOIN {a} y ON x.part = y.part AND x.pos // 8 = y.pos // 8 GROUP BY x.part, x.pos, x.n)""")
    return ",\n".join(out)


def _fold_sql(name: str, before: str, after: str, levels: int) -> str:
    """CTEs that fold {before}(key, part, pos, proof, node) through the levels of a tree, as {after}."""
    out, now = [], before
    for k in range(levels):
        to = after if k == levels - 1 else f"{after}_{k}"
        out.append(f"""{to} AS (SELECT f.* REPLACE (f.proof || s.l || s.r AS proof, CASE WHEN s.n > 1 THEN sha256(s.l || f.node || s.r) ELSE f.node END AS node)
  FROM {now} f JOIN {name}_s{k} s ON s.part = f.part AND s.pos = f.pos // {8**k})""")
        now = to
    return ",\n".join(out)


def _merkle_sql() -> str:
    field = lambda x: f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"
    fixed = " || ".join(map(field, merkle.FIELDS[:-1]))
    lower = f"translate(text, '{merkle._UPPER}', '{merkle._LOWER}')"
    return f"""WITH {_CRC_TABLE},
d AS (SELECT doc_id, coalesce('=' || lang, '-') AS part, sha256({fixed} || {field("text")}) AS leaf, CASE WHEN {_crc32("doc_id::VARCHAR")} % 3 = 0 THEN sha256({fixed} || {field(lower)}) END AS tampered FROM documents, crc_table),
e AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY part) AS n FROM d),
a0 AS (SELECT part, pos, leaf AS h, n FROM e),
{_tree_sql("a", 8)},
z AS (SELECT part AS lang, h AS subroot, row_number() OVER (ORDER BY part) - 1 AS pos, count(*) OVER () AS n FROM a8),
b0 AS (SELECT '' AS part, pos, subroot AS h, n FROM z),
{_tree_sql("b", 4)},
f AS (SELECT doc_id, leaf, part, pos, '' AS proof, coalesce(tampered, leaf) AS node FROM e),
{_fold_sql("a", "f", "g", 8)},
h AS (SELECT doc_id, leaf, subroot, '' AS part, z.pos, proof, node FROM g JOIN z ON z.lang = g.part),
{_fold_sql("b", "h", "i", 4)}
SELECT doc_id, leaf, subroot, (SELECT h FROM b4) AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = (SELECT h FROM b4) AS verified FROM i"""


ORACLES["op11_merkle_manifest"] = _merkle_sql()
ORACLES["op12_spelling_variants"] = f"""WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS c FROM r GROUP BY doc_id, w),
h AS (SELECT w, c, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || w")} AS h FROM c, crc_table),
k AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM h),
v AS (SELECT word, sum(c)::BIGINT AS n FROM k WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
x AS (SELECT word, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM v)),
s AS (SELECT x.word AS a, v.word AS b FROM x JOIN v ON x.rest = v.word),
m AS (SELECT y.word AS a, z.word AS b FROM x y JOIN x z ON y.rest = z.rest AND y.p = z.p AND y.word <> z.word UNION SELECT a, b FROM s UNION SELECT b, a FROM s),
o AS (SELECT a AS word, b AS form, v.n AS form_n, row_number() OVER (PARTITION BY a ORDER BY v.n DESC, b) AS k, count(*) OVER (PARTITION BY a) AS n_near FROM m JOIN v ON v.word = m.b),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * v.n THEN form END AS form, CASE WHEN form_n >= 5 * v.n THEN form_n END AS form_n FROM v LEFT JOIN o ON o.word = v.word AND o.k = 1),
t AS (SELECT word, word AS root, 0 AS steps FROM f UNION ALL SELECT t.word, f.form, steps + 1 FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL),
e AS (SELECT word, arg_max(root, steps) AS root FROM t GROUP BY word)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, e.root FROM f JOIN e ON e.word = f.word"""
