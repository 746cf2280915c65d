"""The queries of the ten operators over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, collocations, decontam, langid, licenses, packing, periodic, secret_scan, simhash, substrings, token_files, urls

#: Rules of op5: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summarised(licenses.find_licences(_table(spark, sf_dir, "documents")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.remove_repeats(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_leaked", F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"), F.size("items").cast("long").alias("n_items"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.match_rules(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments, lengths = token_files.write(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read(segments, lengths)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda f: f["rank"] <= secret_scan.BASE)
    joined = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    counts = [
        F.size(F.filter("found", _of(i))).cast("long").alias(f"n_{name}") for i, name in enumerate(("assign", "access", "hex"), 1)
    ]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def _of(rank: int):
    return lambda f: f["rank"] == rank


def _with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, told by a hash of the key, the words from some place on
    repeat with a period. A null key is in no tenth."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    picked = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    split = picked.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    n = F.size("words")
    begin = split.withColumn("a", F.when(n > 0, F.col("g") % n))
    period = begin.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    repeated = F.array_join(F.transform("words", lambda _, i: F.get("words", place(i))), " ")
    return period.select("doc_id", F.when(F.col("p").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(_with_periods(_table(spark, sf_dir, "documents")))
    more = lambda best, run: run["length"] * best["period"] > best["length"] * run["period"]
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda best, run: F.when(more(best, run), run).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    ranked = found.withColumn("best", best)
    return ranked.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"),
    )


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_simhash, op2_licences, op3_substring_dedup, op4_decontamination, op5_url_rules, op6_nearest, op7_language_id, op8_bpe, op9_token_files, op10_secrets, op11_periodic_runs, op12_packing, op13_collocations)}


def _pattern(parts: list) -> str:
    """A licence sentence as a pattern over words with a space after each, and `~ ~` for a line's end."""
    gap = " (?:~ ~ )?"
    each = {"*": f"(?:[^ |~]+{gap}){{1,{licenses.SLOT}}}", "...": "[^|]*"}
    return "".join("(?:" + "|".join(map(_pattern, x)) + ")" if isinstance(x, list) else each.get(x, x + gap) for x in parts)


def _words(parts: list) -> int:
    return sum(max(map(_words, x)) if isinstance(x, list) else x not in ("*", "...") for x in parts)


def _op2() -> str:
    """Words with `| |` where a sentence ends and `~ ~` where a line does; known sentences between such marks,
    those of most words first; then the rules from the longest on: a match is replaced by a mark."""
    known = sorted(((name, licenses.tree_of(x)) for name, x in licenses.SENTENCES.items()), key=lambda x: -_words(x[1]))
    every = "|".join(f"{_pattern(parts)}" for _, parts in known)
    names = " ".join(f"WHEN regexp_full_match(m, '{_pattern(parts)}') THEN '<{name}>'" for name, parts in known)
    rules = sorted(licenses.RULES, key=lambda r: -len(r.sentences))
    steps = "d AS (SELECT doc_id, string_agg(id, '' ORDER BY i) AS s0 FROM k GROUP BY doc_id)"
    for i, rule in enumerate(rules):
        whole = "".join(f"<{x}>" for x in rule.sentences)
        steps += f",\nr{i} AS (SELECT *, (length(s{i}) - length(replace(s{i}, '{whole}', ''))) // {len(whole)} AS n{i}, replace(s{i}, '{whole}', '#') AS s{i + 1} FROM {f'r{i - 1}' if i else 'd'})"
    found = ", ".join(f"CASE WHEN n{i} > 0 THEN '{r.licence}' END" for i, r in enumerate(rules))
    stop, line = "\ue000", "\ue001"
    spdx = ", ".join(f"'{x.upper()}'" for x in licenses.SPDX)
    return rf"""
WITH l AS (SELECT doc_id, replace(regexp_replace(lower(coalesce(text, '')), '[.!?;:]([\s\p{{Z}}\x0B\x1C-\x1F\x85]|$)', ' {stop} \1', 'g'), chr(10), ' {line} ') AS t FROM documents),
n AS (SELECT doc_id, regexp_replace('{stop} ' || t || ' {stop}', '[^\p{{L}}\p{{N}}{stop}{line}]+', ' ', 'g') AS t FROM l),
b AS (SELECT doc_id, replace(replace(regexp_replace(t, '[{stop}{line}](?: *[{stop}{line}])+', '{stop}', 'g'), '{stop}', '| |'), '{line}', '~ ~') AS t FROM n),
f AS (SELECT doc_id, regexp_extract_all(t, '[|~] ({every})[|~]', 1) AS ms FROM b),
k AS (SELECT doc_id, i, CASE {names} END AS id FROM (SELECT doc_id, unnest(ms) AS m, unnest(range(len(ms))) AS i FROM f)),
{steps},
x AS (SELECT doc_id, regexp_replace(e, '(?i)\bwith[ \t]+[A-Za-z0-9.+-]+', ' ', 'g') AS e FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)spdx-license-identifier:[ \t]*([^\r\n]+)', 1)) AS e FROM documents)),
y AS (SELECT doc_id, rtrim(u, '.') AS u FROM (SELECT doc_id, unnest(regexp_extract_all(e, '[A-Za-z0-9][A-Za-z0-9.+-]*')) AS u FROM x) WHERE regexp_replace(upper(rtrim(u, '.')), '([+]|-ONLY|-OR-LATER)$', '') IN ({spdx}) OR upper(u) LIKE 'LICENSEREF-%'),
z AS (SELECT doc_id, count(*) AS n, list(u) AS us FROM y GROUP BY doc_id)
SELECT f.doc_id, len(ms)::BIGINT AS n_sentences, (coalesce({" + ".join(f"n{i}" for i in range(len(rules)))}, 0) + coalesce(z.n, 0))::BIGINT AS n_matches,
       array_to_string(list_sort(list_distinct(list_filter(list_concat([{found}], coalesce(us, [])), lambda v: v IS NOT NULL))), ',') AS licences
FROM f LEFT JOIN r{len(rules) - 1} AS r ON r.doc_id = f.doc_id LEFT JOIN z ON z.doc_id = f.doc_id
"""


_OP3 = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
first AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN first USING (s) WHERE d < doc_id),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

_OP4 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM benchmark),
dw AS (SELECT doc_id, i, ws[i:i+12] AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
bw AS (SELECT DISTINCT item_id, ws[i:i+12] AS x FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM b)),
dp AS (SELECT doc_id, i, x, p, array_to_string(CASE p WHEN 1 THEN x[1:4] WHEN 2 THEN x[5:8] ELSE x[9:13] END, ' ') AS k FROM dw, (VALUES (1), (2), (3)) AS parts(p)),
bp AS (SELECT item_id, x AS y, p, array_to_string(CASE p WHEN 1 THEN x[1:4] WHEN 2 THEN x[5:8] ELSE x[9:13] END, ' ') AS k FROM bw, (VALUES (1), (2), (3)) AS parts(p)),
hit AS (SELECT DISTINCT doc_id, i, 13 AS n, item_id FROM dp JOIN bp USING (p, k)
        WHERE len(list_filter(range(1, 14), lambda j: x[j] <> y[j])) <= 2
        UNION SELECT doc_id, i, len(b.ws) AS n, item_id FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d) AS e, b
        WHERE len(b.ws) BETWEEN 1 AND 12 AND e.ws[i:i+len(b.ws)-1] = b.ws),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_leaked FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items, count(*) AS n_items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, coalesce(n_leaked, 0)::BIGINT AS n_leaked, coalesce(items, '') AS items, coalesce(n_items, 0)::BIGINT AS n_items
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP5 = r"""
WITH r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC) AS n
      FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT u.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM m WHERE n = 1) AS b ON u.page_id = b.page_id
"""

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

_KEY = secret_scan.key_pattern(secret_scan.GAP).replace("'", "''")


def _op10() -> str:
    kinds = [("assign", _ASSIGN, 12, 2), ("access", "AKIA[A-Z0-9]+", 18, 0), ("hex", "[0-9a-f]+", 16, 0), ("pem", _KEY, 1, 0)]
    each = " UNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, {least} AS least, string_split_regex(t, '{p}') AS gap, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS g FROM d"
        for rank, (kind, p, least, group) in enumerate(kinds, 1)
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS ({each}),
x AS (SELECT doc_id, kind, rank, i, gap, m FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k) WHERE length(g[i]) >= least),
s AS (SELECT doc_id, kind, rank, (list_sum(list_transform(gap[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i-1], lambda y: length(y))), 0))::BIGINT AS a, length(m[i]) AS n FROM x),
o AS (SELECT doc_id, count(*) FILTER (rank = 1) AS n_assign, count(*) FILTER (rank = 2) AS n_access, count(*) FILTER (rank = 3) AS n_hex,
             string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, rank) FILTER (rank <= 3) AS base,
             string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, rank) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (doc_id)
"""


_OP13 = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM t),
total AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM w GROUP BY lang),
f AS (SELECT lang, m, phrase, count(*)::HUGEINT AS f FROM (
        SELECT lang, m, array_to_string(ws[i:i+m-1], ' ') AS phrase FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (VALUES (1), (2), (3), (4), (5)) AS sizes(m)))
      GROUP BY lang, m, phrase),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m >= 2 AND f >= 100),
cut AS (SELECT lang, m, phrase, a, k, array_to_string(ws[1:k], ' ') AS p, array_to_string(ws[k+1:], ' ') AS q FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT cut.lang, cut.m, cut.phrase, a, k, x.f AS l, y.f AS r, n, (1000 * a * n) // (x.f * y.f) AS score
      FROM cut JOIN f AS x ON x.lang = cut.lang AND x.phrase = p JOIN f AS y ON y.lang = cut.lang AND y.phrase = q JOIN total ON total.lang = cut.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT DISTINCT lang, array_to_string(ws[i:i+m2-1], ' ') AS phrase, a FROM (SELECT lang, ws, a, m, m2, unnest(range(1, m - m2 + 2)) AS i FROM c, (VALUES (2), (3), (4)) AS sizes(m2) WHERE m2 < m)),
gone AS (SELECT DISTINCT best.lang, best.phrase FROM best JOIN inner_ AS i ON i.lang = best.lang AND i.phrase = best.phrase AND 100 * i.a >= 100 * best.a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best ANTI JOIN gone USING (lang, phrase))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM r WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_collocations": _OP13, "op2_licences": _op2(), "op3_substring_dedup": _OP3, "op4_decontamination": _OP4, "op5_url_rules": _OP5, "op10_secrets": _op10()}
