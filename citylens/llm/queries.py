"""The operators as queries over the test tables, with their SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citylens.llm import chat, contamination, exact, language, mixing, passages, periods, phrases, quality, scoring, secrets, simhash, urls
from citylens.llm.common import WORD, table
from citylens.session import parameter_table

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
PROBE = "</s>[INST] ok [/INST]"


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = parameter_table(spark, "host string, path string, verdict string", URL_RULES)
    return urls.judge_urls(table(spark, folder, "pages"), rules, "page_id").select("page_id", "host", "path", "rule", "verdict")


def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.simhash_groups(table(spark, folder, "documents"))
    return found.withColumn("fingerprint", simhash.hex_digits(F.col("fingerprint")))


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, folder, "documents"))

    def listed(spans: Column) -> Column:
        names = F.array(*[F.lit(k) for k in secrets.KINDS])
        return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s.kind], s.start.cast("string"), s.end.cast("string"))), ",")

    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "more")).alias("spans"),
    )


def op6_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.lm_scores(table(spark, folder, "documents"))


def op7_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    probe = parameter_table(spark, "conv_id bigint, turn bigint, role string, text string", [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)])
    turns = table(spark, folder, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t.role == "assistant"), lambda t: t.text), "")
    return chat.format_chats(turns).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(table(spark, folder, "documents")).withColumnRenamed("digest", "text_sha256")


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.mine_phrases(table(spark, folder, "documents"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periods.periodic_runs(_repeating(table(spark, folder, "documents")))
    # The greatest length / period without rounding; of ties the first, as runs are sorted.
    better = lambda best, r: best.isNull() | (r.length * best.period > best.length * r.period)
    best = F.reduce("runs", F.expr("CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>)"), lambda best, r: F.when(better(best, r), r).otherwise(best))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _repeating(docs: DataFrame) -> DataFrame:
    """The texts of the contract: with h = crc32(doc_id) and h % 10 = 0, words from a on repeat with period p."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD})"), 1)
    marked = docs.select("doc_id", "text", crc.alias("h"), F.floor(crc / 10).alias("g")).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    sized = marked.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.expr("CAST(g % n AS INT)"))).withColumn("p", F.expr("CAST(1 + (n - a) div (3 + g % 8) AS INT)"))
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.expr("CAST(1 + (n - a) div p AS INT)"))), 1, F.col("n") - F.col("a"))
    return sized.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.slice("w", 1, F.col("a")), tail), " ")).otherwise(F.col("text")).alias("text"))


def op13_passages(spark: SparkSession, folder: str) -> DataFrame:
    found = passages.drop_passages(table(spark, folder, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


LLM_QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_mix_sources, op3_decontaminate, op4_simhash, op5_secrets, op6_lm_score, op7_chat_format, op8_exact_dedup, op9_quality, op10_language,
    op11_phrases, op12_periodic_runs, op13_passages,
)}

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LLM_ORACLES = {
    "op1_url_filter": f"""
        WITH parts AS (
            SELECT row_number() OVER () AS n, page_id,
                   {LOWER.format("coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '')")} AS host,
                   coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
            FROM pages),
        rules(rule_host, rule_path, rule_verdict) AS (
            VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        best AS (
            SELECT n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
            FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY n)
        SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (n)
    """,
    "op2_mix_sources": r"""
        WITH RECURSIVE sized AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                   md5('7|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS k
            FROM documents),
        src AS (
            SELECT source, sum(size)::BIGINT AS source_size, (ARRAY[5.0, 2.0, 1.0])[1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3]::DOUBLE AS w
            FROM sized GROUP BY source),
        ranked AS (
            SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source) AS r FROM src),
        levels AS (
            SELECT r, cap, w, (1.5::DOUBLE * (SELECT sum(source_size) FROM src) - coalesce(sum(cap) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / sum(w) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked),
        final AS (SELECT level FROM levels WHERE level * w < cap ORDER BY r LIMIT 1),
        goal AS (
            SELECT source, source_size, CASE WHEN w * (SELECT level FROM final) >= cap THEN cap ELSE coalesce(w * (SELECT level FROM final), cap) END AS target FROM ranked),
        plan AS (
            SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS repeats FROM goal),
        placed AS (
            SELECT d.*, p.source_size, p.target, p.repeats, floor(p.target + 0.5)::BIGINT - p.repeats * p.source_size AS rest,
                   coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
        SELECT doc_id, source, size, source_size, target, (repeats * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM placed
    """,
    "op7_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        escaped AS (
            SELECT *, length(replace(replace(replace(replace(text, '\', '\\'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '</s>', '<\/s>')) AS longer,
                   instr(text, '\') BETWEEN 1 AND length(text) - 1 OR contains(text, '[INST]') OR contains(text, '[/INST]') OR contains(text, '</s>') AS meets
            FROM turns)
        SELECT conv_id, count(*)::BIGINT AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(6 + length(role) + 7 + CASE WHEN meets THEN longer ELSE length(text) END + 4)::BIGINT AS formatted_chars
        FROM escaped GROUP BY conv_id
    """,
    "op8_exact_dedup": f"""
        WITH folded AS (SELECT doc_id, {LOWER.format("coalesce(text, '')")} AS t FROM documents),
        grouped AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM folded)
        SELECT doc_id, sha256(t) AS text_sha256, keep_id, group_size, doc_id = keep_id AS kept FROM grouped
    """,
    "op11_phrases": rf"""
        WITH pieces AS (
            SELECT row_number() OVER () AS piece, lang, regexp_extract_all(t, '[^\x20\x09]+') AS w
            FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS t FROM documents)),
        grams AS (
            SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
            FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces), range(1, 6) AS g(m)
            WHERE i + m - 1 <= len(w)),
        counts AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
        sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY lang),
        candidates AS (SELECT * FROM counts WHERE m > 1 AND f >= 100),
        kept AS (
            SELECT * FROM candidates c WHERE NOT EXISTS (
                FROM candidates d WHERE d.lang = c.lang AND d.m > c.m AND 100 * d.f >= 100 * c.f AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
        cuts AS (
            SELECT lang, phrase, f, k, array_to_string(list_slice(string_split(phrase, ' '), 1, k), ' ') AS head, array_to_string(list_slice(string_split(phrase, ' '), k + 1, m), ' ') AS rest
            FROM kept, range(1, 5) AS c(k) WHERE k < m),
        scored AS (
            SELECT c.lang, c.phrase, c.f AS a, h.f AS l, r.f AS r, n, c.k, ((1000::HUGEINT * c.f * n) // (h.f::HUGEINT * r.f))::BIGINT AS score
            FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = c.head JOIN counts r ON r.lang = c.lang AND r.phrase = c.rest JOIN sizes s ON s.lang = c.lang),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best)
        SELECT * FROM ranked WHERE rank <= 2000
    """,
    # crc32 bit by bit; a period divides the text where a word equals the one q words on, in a row.
    "op12_periodic_runs": r"""
        WITH bits AS (
            SELECT row_number() OVER () AS d, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
                   flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: list_transform(range(8), lambda k: CASE WHEN c = '' THEN NULL ELSE (ascii(c) >> k) & 1 END))) AS b
            FROM documents),
        hashed AS (
            SELECT d, doc_id, w, len(w) AS n,
                   xor(list_reduce(list_concat([4294967295::BIGINT], list_filter(b, lambda x: x IS NOT NULL)), lambda c, x: xor(xor(c, x::BIGINT) >> 1, 3988292384::BIGINT * (xor(c, x::BIGINT) & 1))), 4294967295::BIGINT) AS h
            FROM bits),
        shaped AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) END AS p FROM hashed),
        pos AS (
            SELECT d, n, i, w[1 + CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % p END] AS word
            FROM (SELECT *, unnest(range(n)) AS i FROM shaped)),
        equal AS (SELECT x.d, x.i, y.i - x.i AS q FROM pos x JOIN pos y ON x.d = y.d AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
        stretches AS (
            SELECT d, q, min(i) AS start, count(*) + q AS length
            FROM (SELECT *, i - row_number() OVER (PARTITION BY d, q ORDER BY i) AS g FROM equal) GROUP BY d, q, g
            HAVING count(*) + q >= greatest(24, 3 * q)),
        runs AS (SELECT d, start, length, min(q) AS period FROM stretches GROUP BY d, start, length),
        told AS (SELECT d, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t FROM runs GROUP BY d),
        best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY d ORDER BY length::DOUBLE / period DESC, start, period) = 1),
        gone AS (SELECT DISTINCT d, unnest(range(start + period, start + length)) AS i FROM runs),
        kept AS (SELECT d, string_agg(word, ' ' ORDER BY i) AS t FROM pos ANTI JOIN gone USING (d, i) GROUP BY d)
        SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
               sha256(coalesce(told.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
        FROM shaped LEFT JOIN told USING (d) LEFT JOIN best USING (d) LEFT JOIN kept USING (d)
    """,
    "op13_passages": r"""
        WITH docs AS (SELECT row_number() OVER () AS d, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        windows AS (SELECT d, doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM docs)),
        low AS (SELECT t, min(doc_id) AS m FROM windows GROUP BY t),
        gone AS (SELECT DISTINCT d, unnest(range(i, i + 13)) AS i FROM windows JOIN low USING (t) WHERE m < doc_id),
        removed AS (SELECT d, count(*) AS n FROM gone GROUP BY d),
        pos AS (SELECT d, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs),
        kept AS (SELECT d, string_agg(word, ' ' ORDER BY i) AS t FROM pos ANTI JOIN gone USING (d, i) GROUP BY d)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM docs LEFT JOIN removed USING (d) LEFT JOIN kept USING (d)
    """,
}
