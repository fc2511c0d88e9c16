"""Queries over the corpus tables, one thin query for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomframe.llm.substring_dedup import remove_repeated

    out = remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLES: dict[str, str] = {}


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomframe.llm.line_rules import line_frequency_rules

    out = line_frequency_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES["op3_line_frequency"] = op3_line_frequency
ORACLES["op3_line_frequency"] = r"""
WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
k AS (SELECT doc_id, i, ws[i:i + 4] AS win FROM g),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM k) WHERE c > 1),
rep AS (SELECT doc_id, count(*) AS r FROM (SELECT DISTINCT doc_id, i + j AS p FROM dup, range(5) AS x(j)) GROUP BY doc_id),
l AS (SELECT doc_id, host, t, unnest(ls) AS line FROM w),
nl AS (SELECT doc_id, host, t, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
  regexp_replace(regexp_replace(lower(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g') AS line FROM l),
hosts AS (SELECT host, count(DISTINCT doc_id) AS docs FROM d GROUP BY host),
common AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT doc_id) AS c FROM nl GROUP BY host, line) JOIN hosts USING (host) WHERE c >= 10 AND c > 0.1 * docs),
rem AS (SELECT doc_id, sum(n) AS n FROM nl JOIN common USING (host, line) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words, coalesce(rem.n, 0) AS gone
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN rem USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND gone <= 0.5 * n_words AS kept FROM b
"""


def op1_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomframe.llm import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    seen = table(spark, sf_dir, "labels").filter(quality.crc_rest(F.col("doc_id"), 5) != 0)
    out = quality.score(docs, quality.train(docs, seen))
    return out.select("doc_id", (quality.crc_rest(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomframe.llm import langid, quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(quality.crc_rest(F.col("doc_id"), 3) != 1))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (quality.crc_rest(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


QUERIES |= {"op1_bradley_terry": op1_bradley_terry, "op9_language_id": op9_language_id}


def op7_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomframe.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


QUERIES["op7_signature_trees"] = op7_signature_trees


def op5_spherical_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomframe.llm.embedding_dedup import embedding_groups

    return embedding_groups(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


QUERIES["op5_spherical_kmeans"] = op5_spherical_kmeans
ORACLES["op5_spherical_kmeans"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL),
n AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v WHERE list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""


def op6_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomframe.llm import pii

    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.train(pii.labelled_table(spark)))
    return pii.digests(found, "pii_spans", pii.BASE).drop("text", "pii_spans")


def op8_guess_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomframe.llm import pii, secrets

    found = secrets.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pii.digests(found, "secret_spans", secrets.BASE).drop("text", "secret_spans")


QUERIES |= {"op6_crf_pii": op6_crf_pii, "op8_guess_cost": op8_guess_cost}


def op10_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomframe.llm.mixing import mix_sources

    out = mix_sources(table(spark, sf_dir, "documents"))
    rounded = {c: F.round(c, 6).alias(c) for c in ("weight", "probability")}
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", rounded["weight"], rounded["probability"], "sampled")


QUERIES["op10_raking"] = op10_raking


def op4_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomframe.llm import pieces

    coder = pieces.Coder.load()
    out = pieces.decode(pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), coder), coder)
    n = F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long")
    return out.select("doc_id", n.alias("n_pieces"), F.col("text").eqNullSafe(F.col("decoded")).alias("lossless"), F.xxhash64("piece_ids").alias("ids_hash"))


QUERIES["op4_merge_dropout"] = op4_merge_dropout


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline


ORACLES["op2_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM g) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM d, range(35) AS r(j)),
left_ AS (SELECT w.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w) x JOIN w ON w.doc_id = x.doc_id
  WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = x.doc_id AND gone.p = x.p) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN left_ ON left_.doc_id = w.doc_id
"""
ORACLES["op7_signature_trees"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 75 * (x.n + y.n - both_)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT r.a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY 1
"""


def raking_sql(rounds: int = 8, halvings: int = 40, temper: float = 0.7, budget: float = 0.9) -> str:
    """The SQL of op10_raking: one step of fitting, or of halving, a subquery."""
    parts = [r"""d AS (SELECT doc_id, source, lang, coalesce(source, '(none)') AS s, coalesce(lang, '(none)') AS l,
  CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN contains(text, '@') OR contains(text, '+') THEN 'contact' WHEN contains(text, 'icensed under') OR contains(text, 'All rights reserved') THEN 'licence' WHEN length(coalesce(text, '')) < 500 THEN 'note' ELSE 'prose' END AS t,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM documents)""",
        "r0 AS MATERIALIZED (SELECT s, l, t, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(n) AS DOUBLE) AS m FROM d GROUP BY 1, 2, 3 HAVING sum(n) > 0)"]
    for c in "slt":
        parts.append(f"p{c} AS MATERIALIZED (SELECT {c}, pow(sum(n), {temper}) / (SELECT sum(p) FROM (SELECT pow(sum(n), {temper}) AS p FROM r0 GROUP BY {c})) AS share FROM r0 GROUP BY {c})")
    k = 0
    for _ in range(rounds):
        for c in "slt":
            parts.append(f"r{k + 1} AS MATERIALIZED (SELECT s, l, t, n, m * share / have AS m FROM r{k} JOIN p{c} USING ({c}) JOIN (SELECT {c}, sum(m) AS have FROM r{k} GROUP BY {c}) USING ({c}))")
            k += 1
    parts.append(f"w AS MATERIALIZED (SELECT s, l, t, n, m * (SELECT sum(n) FROM r0) / n AS w FROM r{k})")
    parts.append("b AS MATERIALIZED (SELECT sum(w * n) / sum(n) AS w, sum(n) AS n FROM (SELECT round(w, 9) AS w, n FROM w) GROUP BY floor(ln(w) * 1000))")
    parts.append("h0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS lo, (SELECT 1 / min(w) FROM b) AS hi)")
    for i in range(halvings):
        parts.append(f"h{i + 1} AS MATERIALIZED (SELECT CASE WHEN low THEN mid ELSE lo END AS lo, CASE WHEN low THEN hi ELSE mid END AS hi FROM (SELECT lo, hi, (lo + hi) / 2 AS mid, (SELECT sum(n * least(1.0, mid_ * w)) FROM b, (SELECT (lo + hi) / 2 AS mid_ FROM h{i})) < {budget} * (SELECT sum(n) FROM r0) AS low FROM h{i}))")
    return f"""WITH {', '.join(parts)}, o AS (SELECT doc_id, source, lang, d.t AS topic, d.n AS n_tokens, CASE WHEN d.n = 0 THEN 1.0 ELSE coalesce(w, 0.0) END AS weight,
  CASE WHEN d.n = 0 THEN 1.0 ELSE coalesce(least(1.0, (SELECT hi FROM h{halvings}) * w), 0.0) END AS probability FROM d LEFT JOIN w USING (s, l, t))
SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, round(probability, 6) AS probability,
  CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < probability AS sampled FROM o"""


ORACLES["op10_raking"] = raking_sql()


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomframe.llm import fim

    out = fim.restore(fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))
    parts = {"n_units": "n", "form": "form", "prefix_units": "prefix_chars", "middle_units": "middle_chars"}
    return out.select("doc_id", *(F.col(a).alias(b) for a, b in parts.items()), *(F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")))


QUERIES["op12_fill_in_middle"] = op12_fill_in_middle
ORACLES["op12_fill_in_middle"] = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM h),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""


def op13_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from loomframe.llm import token_files

    folder = token_files.new_folder(spark)
    token_files.write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES["op13_rans_tokens"] = op13_rans_tokens


def op11_errata_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomframe.llm import spelling

    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES["op11_errata_tries"] = op11_errata_tries


def _crc_nibbles(polynomial: int = 0xEDB88320) -> list[int]:
    """What four bits of crc32 become."""
    out = list(range(16))
    for _ in range(4):
        out = [x >> 1 ^ polynomial if x & 1 else x >> 1 for x in out]
    return out


ORACLES["op11_errata_tries"] = rf"""
WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS n FROM r WHERE length(w) >= 5 GROUP BY 1, 2),
x AS (SELECT w, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM c),
h AS (SELECT w, n, xor(list_reduce([4294967295::BIGINT] || [CAST(strpos('0123456789ABCDEF', x[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END]) - 1 AS BIGINT) for i in range(1, length(x) + 1)],
  lambda a, b: xor(a >> 4, (CAST({_crc_nibbles()} AS BIGINT[]))[(xor(a, b) & 15) + 1])), 4294967295) AS h FROM x),
k AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM k WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
d AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT d.word AS a, v.word AS b FROM d JOIN v ON v.word = d.cut UNION SELECT v.word, d.word FROM d JOIN v ON v.word = d.cut UNION SELECT x.word, y.word FROM d x JOIN d y ON x.cut = y.cut AND x.i = y.i AND x.word <> y.word),
o AS (SELECT p.a, p.b, v.n, row_number() OVER (PARTITION BY p.a ORDER BY v.n DESC, p.b) AS place, count(*) OVER (PARTITION BY p.a) AS near FROM p JOIN v ON v.word = p.b),
f AS MATERIALIZED (SELECT v.word, CASE WHEN o.n >= 2 * v.n THEN o.b END AS form, v.n, coalesce(near, 0) AS n_near, CASE WHEN o.n >= 2 * v.n THEN o.n END AS form_n FROM v LEFT JOIN o ON o.a = v.word AND place = 1),
t AS (SELECT word, word AS cur, 0 AS hops FROM f UNION ALL SELECT t.word, f.form, hops + 1 FROM t JOIN f ON f.word = t.cur WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, max_by(cur, hops) AS root FROM t GROUP BY 1) g ON g.word = f.word
"""
