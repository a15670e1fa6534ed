"""One query opN_<name> for each operator of this package, and DuckDB SQL where it can say the same."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fill_in_middle, fingerprint, hard_negatives, lm_score, mixture, near_dedup, near_equal_packing, packing, secrets, substring_dedup, toxicity, url_filter

#: The rules of the url query.
URL_RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    target = table(spark, sf_dir, "labels").where("quality = 1 and doc_id is not null").select("doc_id")
    scored = lm_score.scores(docs, lm_score.fit(docs, target), target)
    return scored.withColumns({c: F.round(c, 9) for c in ("target_loss", "background_loss", "score")})


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", decontaminate.items_digest("items").alias("items_sha256"), "contaminated", "longest")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES).drop("component")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), secrets.train(secrets.labelled_findings()))


def op7_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle.with_restored(fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.when(finite, F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), whole.alias("vector"))
    return hard_negatives.mine(rows, lambda i: i % 100 == 0)


def op13_near_equal_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = near_equal_packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {
    f.__name__: f
    for f in (
        op1_lm_scoring,
        op2_toxicity,
        op3_benchmark_decontamination,
        op4_url_filter,
        op5_source_mixing,
        op6_secret_scan,
        op7_packed_tokens,
        op8_substring_dedup,
        op9_fingerprint,
        op10_minhash_near_dedup,
        op11_fill_in_middle,
        op12_hard_negatives,
        op13_near_equal_packing,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _loss_sql(count: str, words: str, texts: str, own: str) -> str:
    """-log p of a word by the counts ``count``, where ``own`` is 1 if the text's own counts are left out."""
    left = lambda c, mine: f"(coalesce({c}, 0) - {own} * {mine})"
    single = f"({left(f'w.{count}', 'ow.k')} + {lm_score.BETA}e0) / ({words} - {own} * t.n + {lm_score.BETA}e0 * v)"
    context = f"CASE WHEN t.i = 1 THEN {texts} - {own} ELSE {left(f'b.{count}', 'ob.k')} END"
    return f"-ln(({left(f'p.{count}', 'op.k')} + {lm_score.ALPHA}e0 * {single}) / ({context} + {lm_score.ALPHA}e0))"


_OP1 = f"""WITH target AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id IN (SELECT doc_id FROM target), false)::INT AS inside, regexp_extract_all(coalesce({_LOWER.format("text")}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
t AS (SELECT r, inside, len(ws) AS n, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i, unnest(list_prepend('', ws[:-2])) AS b FROM docs WHERE len(ws) > 0),
cw AS (SELECT w, count(*) AS c, sum(inside) AS ci FROM t GROUP BY w), cp AS (SELECT b, w, count(*) AS c, sum(inside) AS ci FROM t GROUP BY b, w),
ow AS (SELECT r, w, count(*) AS k FROM t GROUP BY r, w), op AS (SELECT r, b, w, count(*) AS k FROM t GROUP BY r, b, w),
s AS (SELECT count(*) FILTER (WHERE len(ws) > 0) AS texts, count(*) FILTER (WHERE len(ws) > 0 AND inside = 1) AS texts_in, coalesce(sum(len(ws)), 0) AS words, coalesce(sum(len(ws)) FILTER (WHERE inside = 1), 0) AS words_in, greatest((SELECT count(*) FROM cw), 1) AS v FROM docs),
losses AS (SELECT t.r, avg({_loss_sql("ci", "words_in", "texts_in", "t.inside")}) AS target, avg({_loss_sql("c", "words", "texts", "1")}) AS ground
 FROM t CROSS JOIN s JOIN cw w ON w.w = t.w JOIN cp p ON p.b = t.b AND p.w = t.w JOIN ow ON ow.r = t.r AND ow.w = t.w JOIN op ON op.r = t.r AND op.b = t.b AND op.w = t.w
 LEFT JOIN cw b ON b.w = t.b LEFT JOIN ow ob ON ob.r = t.r AND ob.w = t.b GROUP BY t.r)
SELECT doc_id, len(ws)::BIGINT AS n_words, round(coalesce(target, 0), 9) AS target_loss, round(coalesce(ground, 0), 9) AS background_loss, round(coalesce(target - ground, 0), 9) AS score FROM docs LEFT JOIN losses USING (r)"""

_OP3 = f"""WITH items AS (SELECT row_number() OVER () AS k, item_id::VARCHAR AS item, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
suffixes AS (SELECT k, item, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS place FROM items WHERE len(w) > 0),
windows AS (SELECT k, item, n, place, array_to_string(w[place:place + n - 1], ' ') AS win FROM suffixes),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce({_LOWER.format("text")}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
places AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
hits AS (SELECT p.r, p.i, p.n, k, item, place FROM (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM places) p JOIN windows USING (n, win)),
covered AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY r),
followed AS (SELECT r, n, k, i - place AS d, i - row_number() OVER (PARTITION BY r, k, i - place ORDER BY i) AS run FROM hits),
longest AS (SELECT r, max(m) AS longest FROM (SELECT r, n + count(*) - 1 AS m FROM followed GROUP BY r, n, k, d, run) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(longest, 0)::BIGINT AS longest FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r) LEFT JOIN longest USING (r)"""


def _rule_sql(host: str, path: str, what: str) -> str:
    cases = " ".join(f"WHEN ({host} = '{r.host}' OR ends_with({host}, '.{r.host}')) AND starts_with({path}, '{r.path}') THEN '{r.text if what == 'rule' else r.verdict}'" for r in url_filter._ranked(URL_RULES))
    return f"CASE {cases} END"


_HOST, _PATH = "coalesce(translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')", "coalesce(regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
_ADDRESS = f"CASE WHEN contains({{u}}, '://') THEN {_HOST} || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END || regexp_extract({{u}}, '(?s)^.*?://[^/?#]*[^?#]*(\\?[^#]*)', 1) END"
_OP4 = f"""WITH RECURSIVE own AS (SELECT page_id, url, {_HOST.format(u="url")} AS host, {_PATH.format(u="url")} AS path, {_ADDRESS.format(u="url")} AS address FROM pages),
refs AS (SELECT url AS u, replace(r, '&amp;', '&') AS r FROM (
  SELECT url, regexp_extract(regexp_extract(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>'), '(?is)\\bhref\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1) AS r FROM pages UNION ALL
  SELECT url, regexp_extract(regexp_extract(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>'), '(?is)\\burl\\s*=\\s*["'']?\\s*([^"''\\s>;]+)', 1) FROM pages) WHERE r <> '' AND url IS NOT NULL),
full_refs AS (SELECT u, CASE WHEN regexp_matches(r, '(?s)^[A-Za-z][A-Za-z0-9+.-]*://') THEN r WHEN starts_with(r, '//') THEN 'http:' || r WHEN starts_with(r, '/') THEN 'http://' || {_HOST.format(u="u")} || r
  ELSE 'http://' || {_HOST.format(u="u")} || CASE WHEN regexp_extract({_PATH.format(u="u")}, '(?s)^(.*/)', 1) = '' THEN '/' ELSE regexp_extract({_PATH.format(u="u")}, '(?s)^(.*/)', 1) END || r END AS f FROM refs),
edges AS (SELECT DISTINCT {_ADDRESS.format(u="u")} AS a, {_ADDRESS.format(u="f")} AS b FROM full_refs),
two_way AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach AS (SELECT a AS x, a AS y FROM two_way UNION SELECT x, b FROM reach JOIN two_way ON y = a),
verdicts AS (SELECT y, {_rule_sql(_HOST.format(u="'://' || y"), _PATH.format(u="'://' || y"), "verdict")} AS v FROM (SELECT DISTINCT y FROM reach)),
alias AS (SELECT x, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' END AS v FROM reach JOIN verdicts USING (y) GROUP BY x)
SELECT page_id, host, path, {_rule_sql("host", "path", "rule")} AS rule, coalesce({_rule_sql("host", "path", "verdict")}, alias.v, 'allow') AS verdict FROM own LEFT JOIN alias ON alias.x = own.address"""

_OP10 = f"""WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM docs),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.x = b.x AND a.doc_id <> b.doc_id AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85 GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM docs UNION SELECT x, b FROM reach JOIN links ON y = a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM sets JOIN (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x) USING (doc_id)"""

_H = "('0x' || substr(h, {}, 8))::UBIGINT"
_OP11 = f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
cut AS (SELECT *, regexp_extract_all(t, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u FROM docs),
drawn AS (SELECT *, {_H.format(1)} % (len(u) + 1) AS a, {_H.format(9)} % (len(u) + 1) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_H.format(17)} % 100 >= 50 THEN 'plain' WHEN {_H.format(25)} % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (SELECT *, array_to_string(u[1:least(a, b)::BIGINT], '') AS p, array_to_string(u[least(a, b)::BIGINT + 1:greatest(a, b)::BIGINT], '') AS m, array_to_string(u[greatest(a, b)::BIGINT + 1:], '') AS s FROM drawn)
SELECT doc_id, len(u)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM parts"""

_OP12 = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score FROM positives JOIN scored USING (anchor_id)
 WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 5"""

ORACLES: dict[str, str] = {"op1_lm_scoring": _OP1, "op3_benchmark_decontamination": _OP3, "op4_url_filter": _OP4, "op10_minhash_near_dedup": _OP10, "op11_fill_in_middle": _OP11, "op12_hard_negatives": _OP12}
