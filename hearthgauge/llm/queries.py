"""Registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat_format, conversation_repair, decontaminate, html_text, language_id, license_scan, near_duplicates, packing, personal_data, quality_rules, repeated_passages, spelling_variants

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_passages.remove_repeated_passages(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text_kept", 256).alias("kept_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), TOKENIZER, digests=True, hold=True)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(_table(spark, sf_dir, "documents"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(_table(spark, sf_dir, "pages"))


CONTROL_CASE = "</s>[INST] ok [/INST]"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{CONTROL_CASE}'), (-7L, 1L, 'assistant', '{CONTROL_CASE}') AS own(conv_id, turn, role, text)")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = chat_format.format_conversations(turns)
    said = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat_format.under_mask(F.col("formatted"), F.col("mask"))
    return out.select("conv_id", F.size("parsed").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "contaminated", F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("item_ids"), "n_windows")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data.find_personal_data(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_discovered")
    return out.select("doc_id", *map(count, personal_data.KINDS), F.sha2(personal_data.spans_text(F.col("base")), 256).alias("base_sha256"), personal_data.spans_text(F.col("spans")).alias("spans"), added)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan_licenses(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "n_notices", (F.floor(F.col("best_dice") * 1000 + 0.5) / 1000).alias("best_dice"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = conversation_repair.repair_conversations(conversation_repair.damage(_table(spark, sf_dir, "conversations")))
    said = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(said, 256).alias("repaired_sha256"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(_table(spark, sf_dir, "documents"), TOKENIZER, hold=True)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_near_duplicates, op2_repeated_passages, op3_bpe, op4_language_id, op5_main_text, op6_chat_format, op7_decontaminate, op8_personal_data, op9_license_scan, op10_quality_rules, op11_spelling_variants, op12_conversation_repair, op13_packing, pipeline)}

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

OP1_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
many AS (SELECT s FROM sh GROUP BY s HAVING count(*) > 1),
kept AS MATERIALIZED (SELECT doc_id, s FROM sh JOIN many USING (s)),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM kept a JOIN kept b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT u, v FROM pairs JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT ways.v, reach.seen FROM reach JOIN ways ON ways.u = reach.node),
comp AS (SELECT node AS doc_id, min(seen) AS component_id FROM reach GROUP BY node),
sets AS (SELECT doc_id, array_to_string(list_sort(list(s)), chr(1)) AS key FROM sh GROUP BY doc_id),
cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY key) AS class_id FROM sets)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(cls.class_id, d.doc_id)::BIGINT AS class_id, comp.component_id::BIGINT AS component_id, d.doc_id = comp.component_id AS kept
FROM documents d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN cls USING (doc_id)
"""

OP2_SQL = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i+12], ' '))) AS g FROM w WHERE len(ws) >= 13),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM dup),
places AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
pos AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
rest AS (SELECT pos.doc_id, string_agg(word, ' ' ORDER BY pos.p) AS t FROM pos ANTI JOIN gone ON gone.doc_id = pos.doc_id AND gone.p = pos.p GROUP BY pos.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(places.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN places USING (doc_id) LEFT JOIN rest USING (doc_id)
"""

_ESC = r"replace(replace(replace(replace(replace({}, '\', '\e'), '</s>', '\c'), '<s>', '\o'), '[INST]', '\i'), '[/INST]', '\j')"
OP6_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
l AS (SELECT *, bool_or(regexp_matches(role, '</?s>|\[/?INST\]') OR regexp_matches(text, '</?s>|\[/?INST\]')) OVER (PARTITION BY conv_id) AS esc FROM t),
r AS (SELECT *, CASE WHEN esc THEN length({_ESC.format('role')}) + length({_ESC.format('text')}) ELSE length(role) + length(text) END AS n FROM l),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, sum(n + 22)::BIGINT + 1 AS formatted_chars FROM r GROUP BY conv_id)
SELECT conv_id::BIGINT AS conv_id, n_turns::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

OP10_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i+7], ' '))) AS g FROM w WHERE len(ws) >= 8),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS n_letters, len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis,
  len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullets, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR n_symbols > n_words OR 100 * n_dup_lines > 30 * n_lines
    OR 100 * n_letters < 40 * word_chars OR 100 * n_ellipsis > 30 * n_lines OR 100 * n_bullets > 90 * n_lines) AS kept FROM b
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op9_sql() -> str:
    rows = ", ".join(f"({k}, {_quoted(name)}, {size}, {_quoted(gram)}, {n})" for k, name, size, gram, n in license_scan.template_bigrams())
    least = license_scan.DICE_LEAST
    return rf"""
WITH tpl(template, license, t_size, gram, t_times) AS (VALUES {rows}),
ps AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls, regexp_split_to_array(text, '\n[\x20\x09-\x0D]*\n') AS paras FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(range(1, len(units) + 1)) AS unit, unnest(units) AS piece FROM (
  SELECT doc_id, list_concat(list_concat(ls, list_filter(paras, lambda p: contains(p, chr(10)))), CASE WHEN len(paras) > 1 THEN [text] ELSE [] END) AS units FROM ps)),
w AS (SELECT doc_id, unit, list_filter(regexp_split_to_array(lower(piece), '[^0-9a-z]+'), lambda x: x <> '') AS ws FROM u),
g AS (SELECT doc_id, unit, len(ws) - 1 AS size, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS gram FROM w WHERE len(ws) >= 2),
c AS (SELECT doc_id, unit, size, gram, count(*) AS times FROM g GROUP BY ALL),
s AS (SELECT doc_id, unit, template, license, size, t_size, sum(least(times, t_times)) AS shared FROM c JOIN tpl USING (gram)
  WHERE size <= t_size * (2 - {least}) / {least} AND t_size <= size * (2 - {least}) / {least} GROUP BY ALL),
d AS (SELECT *, 2.0 * shared / (size + t_size) AS dice FROM s WHERE 2.0 * shared / (size + t_size) >= {least}),
best AS (SELECT doc_id, unit, license, dice FROM d QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, license) = 1),
v AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(*) AS n, max(dice) AS dice FROM best GROUP BY doc_id)
SELECT documents.doc_id, coalesce(licenses, '') AS licenses, coalesce(n, 0)::BIGINT AS n_notices, floor(coalesce(dice, 0.0)::DOUBLE * 1000 + 0.5) / 1000 AS best_dice FROM documents LEFT JOIN v USING (doc_id)
"""


def _crc_table() -> list[int]:
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    return table


#: crc32 of a text (ASCII, and letters up to U+07FF), byte by byte.
_CRC = f"crc AS (SELECT {_crc_table()}::BIGINT[] AS t),"


def _crc32(text: str) -> str:
    code = f"list_transform(string_split({text}, ''), lambda x: ord(x))"
    raw = f"flatten(list_transform({code}, lambda x: CASE WHEN x < 128 THEN [x] ELSE [192 + x // 64, 128 + x % 64] END))"
    return f"xor(list_reduce({raw}, lambda c, b: xor(c >> 8, t[(xor(c, b::BIGINT) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


OP11_SQL = rf"""
WITH RECURSIVE {_CRC}
runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]{{7,}}')) AS run FROM documents),
low AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM low, crc),
dealt AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM dealt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
gone AS MATERIALIZED (SELECT word, n, unnest(range(1, length(word) + 1)) AS at, unnest(list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1))) AS rest FROM words),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM gone a JOIN gone b ON a.rest = b.rest AND a.at = b.at AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gone g JOIN words w ON g.rest = w.word
  UNION SELECT w.word, g.word, g.n FROM gone g JOIN words w ON g.rest = w.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
formed AS MATERIALIZED (SELECT words.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END::BIGINT AS form_n FROM words LEFT JOIN best USING (word)),
way(word, root) AS (SELECT word, word FROM formed UNION ALL SELECT way.word, formed.form FROM way JOIN formed ON formed.word = way.root WHERE formed.form IS NOT NULL),
ends AS (SELECT way.word, way.root FROM way JOIN formed ON formed.word = way.root WHERE formed.form IS NULL)
SELECT word, n, n_near, form, form_n, root FROM formed JOIN ends USING (word)
"""

#: States: 0 at the start, 1 after s, 2 after u, 3 after a. Forward over the rows, with the least (cost, audit) a state.
OP12_SQL = rf"""
WITH RECURSIVE {_CRC}
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h FROM conversations, crc),
dam AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM src, range(CASE WHEN h = 3 THEN 2 ELSE 1 END) WHERE h <> 0),
pos AS (SELECT *, row_number() OVER w AS i, left(role, 1) AS c, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said, lead(left(role, 1)) OVER w AS c2
  FROM dam WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
flt AS MATERIALIZED (SELECT *, CASE WHEN said = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f FROM pos),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate,
  count(*) FILTER (f = 't') AS truncated, count(*) FILTER (c2 IS NOT NULL AND c || c2 NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM flt GROUP BY conv_id),
said(q, q2, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
step(q, c, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
ins(q, q2, edits, roles) AS (SELECT q, q, '', [] FROM said UNION ALL SELECT q, q2, 'I', [role || ':'] FROM said UNION ALL SELECT a.q, b.q2, 'II', [a.role || ':', b.role || ':'] FROM said a JOIN said b ON a.q2 = b.q),
best(conv_id, i, q, least) AS (
  SELECT conv_id, 0, ins.q2, {{'cost': 5 * length(edits), 'audit': edits, 'out': roles}} FROM counts, ins WHERE ins.q = 0
  UNION ALL
  SELECT conv_id, i + 1, q, min(least) FROM (
    SELECT m.conv_id, m.i, ins.q2 AS q, {{'cost': m.least.cost + m.more + 5 * length(edits), 'audit': m.least.audit || m.e || edits, 'out': list_concat(list_concat(m.least.out, m.o), roles)}} AS least
    FROM (
      SELECT b.conv_id, b.i, b.q, 2 AS more, 'D' AS e, []::VARCHAR[] AS o, b.least FROM best b JOIN flt ON flt.conv_id IS NOT DISTINCT FROM b.conv_id AND flt.i = b.i + 1
      UNION ALL
      SELECT b.conv_id, b.i, s.q2, CASE WHEN f = 't' THEN 5 ELSE 0 END, 'K', [flt.role || ':' || text], b.least FROM best b JOIN flt ON flt.conv_id IS NOT DISTINCT FROM b.conv_id AND flt.i = b.i + 1 JOIN step s ON s.q = b.q AND s.c = flt.c WHERE f NOT IN ('b', 'd')
      UNION ALL
      SELECT b.conv_id, b.i, s.q2, CASE WHEN f = 't' THEN 6 ELSE 1 END, 'R', [s.role || ':' || text], b.least FROM best b JOIN flt ON flt.conv_id IS NOT DISTINCT FROM b.conv_id AND flt.i = b.i + 1 JOIN said s ON s.q = b.q WHERE f NOT IN ('b', 'd')
    ) m JOIN ins ON ins.q = m.q) GROUP BY conv_id, i, q),
done AS (SELECT counts.conv_id, min(least) AS least FROM counts JOIN best ON best.conv_id IS NOT DISTINCT FROM counts.conv_id AND best.i = counts.n WHERE q IN (0, 3) GROUP BY ALL),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(least.cost, 0)::BIGINT AS cost, coalesce(least.audit, '') AS audit, sha256(coalesce(array_to_string(least.out, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


ORACLE_SQL = {"op1_near_duplicates": OP1_SQL, "op2_repeated_passages": OP2_SQL, "op6_chat_format": OP6_SQL, "op9_license_scan": op9_sql(), "op10_quality_rules": OP10_SQL, "op11_spelling_variants": OP11_SQL, "op12_conversation_repair": OP12_SQL}
