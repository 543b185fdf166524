"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.llm import chat, html_text, lattice, licenses, line_dedup, minhash, mixing, packing, quality, repair, runs, token_files, toxicity
from sparkfolio.llm.common import new_folder, table, words_of

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op1_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents chosen for the token budget, one row per document and epoch."""
    return mixing.mix(table(spark, sf_dir, "documents")).drop("text_hash")


_FILL = """
{name}_level AS (
  SELECT *, (CAST({budget} AS DOUBLE) - coalesce(sum({cap}) OVER (PARTITION BY {parent} ORDER BY CAST({cap} AS DOUBLE) / w, {key}
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (PARTITION BY {parent} ORDER BY CAST({cap} AS DOUBLE) / w, {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM {source}),
{name} AS (
  SELECT * EXCLUDE (level, w), CAST(floor(least(CAST({cap} AS DOUBLE), w * greatest(max(level) OVER (PARTITION BY {parent}), 0.0))) AS BIGINT) AS {out}
  FROM {name}_level)"""


def _weights(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {mixing.DEFAULT_WEIGHT} END"


SQL["op1_mixing_sources"] = (
    f"""
WITH base AS (
  SELECT doc_id, md5(coalesce(text, '')) AS th,
         coalesce(['{"', '".join(mixing.DOMAINS)}'][try_cast(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS INTEGER) % 4 + 1], 'other') AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CAST(sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))) AS BIGINT) AS n_tokens
  FROM documents GROUP BY ALL),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * {mixing.MAX_EPOCHS} AS cap FROM base GROUP BY ALL),
langs AS (SELECT domain, lang, sum(cap) AS lang_cap, {_weights("lang", mixing.LANG_WEIGHTS)} AS w FROM leaves GROUP BY ALL),
domains AS (
  SELECT domain, sum(lang_cap) AS domain_cap, {_weights("domain", mixing.DOMAIN_WEIGHTS)} AS w, 0 AS root,
         CAST(floor(CAST(sum(sum(lang_cap)) OVER () AS DOUBLE) / {mixing.MAX_EPOCHS} * {mixing.BUDGET_PERCENT} / 100) AS BIGINT) AS total
  FROM langs GROUP BY domain),"""
    + _FILL.format(name="d", budget="total", cap="domain_cap", parent="root", key="domain", source="domains", out="domain_budget")
    + ","
    + _FILL.format(name="l", budget="domain_budget", cap="lang_cap", parent="domain", key="lang", source="(SELECT langs.*, domain_budget FROM langs JOIN d USING (domain))", out="lang_budget")
    + ","
    + _FILL.format(
        name="s", budget="lang_budget", cap="cap", parent="domain, lang", key="source", source=f"(SELECT leaves.*, {mixing.DEFAULT_WEIGHT} AS w, lang_budget FROM leaves JOIN l USING (domain, lang))", out="leaf_budget"
    )
    + f""",
keyed AS (
  SELECT b.*, s.leaf_budget, s.leaf_budget // s.tokens AS full_epochs, s.leaf_budget % s.tokens AS rest,
         md5(concat_ws(':', '{mixing.SEED}', CAST(s.leaf_budget // s.tokens AS BIGINT), coalesce(CAST(doc_id AS VARCHAR), ''))) AS key
  FROM base b JOIN s USING (domain, lang, source) WHERE s.tokens > 0),
timed AS (
  SELECT *, full_epochs + CASE WHEN sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, th ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS times
  FROM keyed)
SELECT doc_id, domain, lang, source, CAST(unnest(range(CAST(times AS BIGINT))) AS BIGINT) AS epoch, n_tokens, leaf_budget
FROM timed WHERE times > 0"""
)


#: One more conversation, whose texts hold the template's own control strings.
HARD_CONVERSATION = r"SELECT * FROM VALUES (-7L, 0L, 'user', r'\### Assistant: </turn> ok'), (-7L, 1L, 'assistant', r'\### Assistant: </turn> ok') AS t(conv_id, turn, role, text)"


@_query
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the formatted conversations, read back from the formatted text."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    back = chat.read_back(chat.format_conversations(turns.unionByName(spark.sql(HARD_CONVERSATION))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


SQL["op5_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
placed AS (
  SELECT *, coalesce(lag(role) OVER w = role, false) AS merged,
         length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) AS chars, length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) AS role_chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars + CASE WHEN merged THEN 5 ELSE role_chars + 15 END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id"""


@_query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base figures and verdicts of all documents."""
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_W = r"[\x20\x09-\x0D]"
_LINE_FAILS = f"""(
  length(line) - length(regexp_replace(line, '{quality.SYMBOLS}', '', 'g')) > length(line) * {quality.MAX_SYMBOL_SHARE}
  OR length(line) - length(replace(line, '|', '')) >= {quality.NAV_SEPARATORS}
  OR (length(line) <= {quality.MENU_MAX_CHARS} AND regexp_matches(line, '{quality.MENU}'))
  OR (length(line) <= {quality.BOILERPLATE_MAX_CHARS} AND regexp_matches(line, '{quality.BOILERPLATE}'))
  OR (NOT regexp_matches(line, '[.,;:!?]') AND regexp_matches(line, '{quality.LONG}')))"""

SQL["op6_quality_rules"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(text, '{_W}+'), lambda x: x <> '') AS words FROM d),
win AS (SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
keyed AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS k FROM win),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM keyed) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
judged AS (
  SELECT rid, count(*) FILTER (regexp_matches(line, '[^\\x20\\x09-\\x0D]')) - count(DISTINCT line) FILTER (regexp_matches(line, '[^\\x20\\x09-\\x0D]')) AS dup,
         coalesce(sum(length(line)) FILTER (NOT {_LINE_FAILS}), 0) + greatest(count(*) FILTER (NOT {_LINE_FAILS}) - 1, 0) AS good_chars
  FROM lines GROUP BY rid),
f AS (
  SELECT doc_id, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         length(text) - length(regexp_replace(text, '{quality.SYMBOLS}', '', 'g')) AS n_symbols, dup AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words, length(text) AS chars, good_chars
  FROM d JOIN w USING (rid) JOIN judged USING (rid) LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND chars - good_chars <= {quality.MAX_LOST_SHARE} * chars AS kept
FROM b"""


@_query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts and the digest of what each document keeps."""
    kept = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL["op9_line_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT k.*, coalesce(k.doc_id <> r.first, false) AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY rid, doc_id"""


@_query
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share at least 85 % of their three-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


@_query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces placed in sequences of 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


@_query
def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link counts and components of all embeddings."""
    return lattice.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


#: The phrases of op4 with their labels.
_PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))


@_query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases, labels and scores of all documents."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), _PHRASES).drop("spans")


@_query
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of all pages."""
    return html_text.extract_text(table(spark, sf_dir, "pages"))


@_query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model fitted to the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).drop("words")


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text), in which each document that the contract names repeats words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(F.col("h") / 10), F.size("ws").cast("long")
    at = F.pmod(F.col("g"), F.col("n"))
    period = 1 + F.floor((F.col("n") - F.col("at")) / (3 + F.pmod(F.col("g"), F.lit(8))))
    place = lambda i: F.when(i < F.col("at"), i).otherwise(F.col("at") + F.pmod(i - F.col("at"), F.col("period"))).cast("int")
    repeated = F.array_join(F.transform("ws", lambda _, i: F.get("ws", place(i))), " ")
    planted = docs.select("doc_id", "text", h.alias("h")).withColumn("ws", F.when(F.col("h") % 10 == 0, words_of(F.col("text"))))
    planted = planted.withColumn("g", g).withColumn("n", n).withColumn("at", F.when(F.col("n") > 0, at)).withColumn("period", period)
    return planted.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


@_query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of all documents, of which one in ten repeats words: count, longest run and digests."""
    found = runs.periodic_runs(_with_planted_runs(table(spark, sf_dir, "documents")))
    # of the longest runs the first, of those the one of the shortest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(-1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@_query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and digest of all conversations, damaged by the contract's rule."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    dealt = turns.withColumn("damage", F.pmod(F.crc32(named.cast("binary")), F.lit(20)))
    damaged = dealt.where("damage <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("damage") == 3, 2).otherwise(1))).alias("copy"),
    )
    told = repair.summary(damaged).withColumnRenamed("conv_id", "id")
    every = turns.select("conv_id").distinct().join(told, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    return every.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in repair.FACTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def _steps() -> str:
    """All ways from state to state over a turn of each kind, with up to two insertions before it, as SQL values."""
    follow = {"n": "u", "s": "u", "u": "a", "a": "u"}  # nothing yet or after a role: the only role that may come next, but for s
    rows = []
    for kind in ("s", "u", "a", "x", "S", "U", "A", "X", "d"):
        for state in follow:
            at = state
            for n in range(3):
                ways = [("D", 2, at)]
                if kind != "d":
                    cut = 5 if kind.isupper() else 0
                    ways.append(("R", 1 + cut, follow[at]))
                    if kind.lower() == follow[at] or (kind.lower(), at) == ("s", "n"):
                        ways.append(("K", cut, kind.lower()))
                rows += [f"('{kind}', '{state}', '{to}', {5 * n + cost}, '{'I' * n + letter}')" for letter, cost, to in ways]
                at = follow[at]
    return ", ".join(rows)


#: The checksum of zip files, as DuckDB has none: a table of 256 entries by the rule, and one step for each byte.
CRC32 = """
crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END))) AS tbl)"""


def _crc32(ascii_text: str) -> str:
    byte = f"list_transform(string_split({ascii_text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {byte}), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])))"


SQL["op12_conversation_repair"] = f"""
WITH RECURSIVE {CRC32.strip()},
t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
d AS (SELECT t.*, {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS damage FROM t, crc),
m AS (
  SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role,
         CASE damage WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE damage WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM d WHERE damage <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM m),
f AS (
  SELECT conv_id, turn, role, text, row_number() OVER w AS i, left(role, 1) AS initial, lag(left(role, 1)) OVER w || left(role, 1) AS pair,
         CASE WHEN said = '' THEN 'b' WHEN again THEN 'd' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault
  FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again, copy)),
k AS (
  SELECT *, CASE WHEN fault IN ('b', 'd') THEN 'd' WHEN initial IN ('s', 'u', 'a') THEN CASE fault WHEN 't' THEN upper(initial) ELSE initial END ELSE CASE fault WHEN 't' THEN 'X' ELSE 'x' END END AS kind
  FROM f),
figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM k GROUP BY conv_id),
steps AS (SELECT * FROM (VALUES {_steps()}) v(kind, from_state, to_state, more, letters)),
best AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 'n' AS state, {{'cost': CAST(0 AS BIGINT), 'audit': ''}} AS least FROM figures
  UNION ALL
  SELECT b.conv_id, b.i + 1, s.to_state, min({{'cost': b.least.cost + s.more, 'audit': b.least.audit || s.letters}})
  FROM best b JOIN k ON k.conv_id IS NOT DISTINCT FROM b.conv_id AND k.i = b.i + 1 JOIN steps s ON s.kind = k.kind AND s.from_state = b.state
  GROUP BY b.conv_id, b.i + 1, s.to_state),
ended AS (
  SELECT f.conv_id, min({{'cost': least.cost + CASE state WHEN 'u' THEN 5 WHEN 's' THEN 10 ELSE 0 END, 'audit': least.audit || CASE state WHEN 'u' THEN 'I' WHEN 's' THEN 'II' ELSE '' END}}) AS least
  FROM figures f JOIN best b ON b.conv_id IS NOT DISTINCT FROM f.conv_id AND b.i = f.n GROUP BY f.conv_id),
edits AS (SELECT conv_id, unnest(string_split(least.audit, '')) AS letter, unnest(range(len(least.audit))) AS j FROM ended WHERE least.audit <> ''),
turned AS (SELECT *, sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY j) AS i FROM edits),
kept AS (
  SELECT e.conv_id, j, letter, CASE WHEN letter = 'I' THEN '' ELSE k.text END AS text, k.role, letter = 'K' AND k.initial = 's' AS system
  FROM turned e LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM e.conv_id AND k.i = e.i WHERE letter <> 'D'),
lines AS (
  SELECT conv_id, j, CASE WHEN letter = 'K' THEN role WHEN (row_number() OVER w - CASE WHEN bool_or(system) OVER (PARTITION BY conv_id) THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text AS line
  FROM kept WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
written AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY j) AS said FROM lines GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(least.cost, 0) AS cost, coalesce(least.audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN written w ON w.conv_id IS NOT DISTINCT FROM c.conv_id"""


@_query
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, lengths and checksums of all documents' token ids, read back from the files that they were written to."""
    path = new_folder(spark, "token-files")
    token_files.write_ids(table(spark, sf_dir, "documents"), path)
    return token_files.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
