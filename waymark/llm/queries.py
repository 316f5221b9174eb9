"""The registered queries of the operators and their SQL counterparts."""

from pyspark.sql import functions as F

from waymark.llm import (chat, decontaminate, jaccard, langid, manifest, matroska, mixing, pii, quality, repair, setsketch,
                         toxicity, warc)
from waymark.llm.textops import documents

_QUERIES, _ORACLES = {}, {}


def query(name: str, sql: str = None):
    def register(build):
        _QUERIES[name] = build
        if sql is not None:
            _ORACLES[name] = sql
        return build

    return register


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_ORACLES)


@query("op3_chat_formatting", """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM c),
b AS (
  SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY k) = role THEN 0 ELSE 1 END AS opens FROM o)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(replace(replace(text, '~', '~0'), '<|', '~1'))
         + CASE WHEN opens = 1
             THEN 12 + length(replace(replace(replace(role, '~', '~0'), '<|', '~1'), chr(10), '~2')) + 1 + 11
             ELSE 8 END) AS BIGINT) AS formatted_chars
FROM b GROUP BY conv_id""")
def op3(spark, sf_dir):
    given = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql("""SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text
                       FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)""")
    return chat.chat_digest(given.unionByName(own))


@query("op4_matroska_columns")
def op4(spark, sf_dir):
    return matroska.media_digest(matroska.mux(documents(spark, sf_dir)))


@query("op8_warc_records", """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN k.keeper IS NULL OR p.page_id = k.keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> k.keeper THEN k.keeper END AS refers_to
FROM p LEFT JOIN k ON p.d = k.d AND p.n >= 1000""")
def op8(spark, sf_dir):
    return warc.digest(documents(spark, sf_dir, "pages"))


@query("op9_personal_data")
def op9(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return pii.find(docs, pii.train(pii.labelled_table(docs)))


@query("op10_benchmark_decontamination")
def op10(spark, sf_dir):
    return decontaminate.contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


@query("op6_quality_classifier")
def op6(spark, sf_dir):
    return quality.classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


@query("op1_toxicity")
def op1(spark, sf_dir):
    return toxicity.classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


@query("op2_language_mixture")
def op2(spark, sf_dir):
    return langid.classify(documents(spark, sf_dir))


@query("op7_jaccard_join")
def op7(spark, sf_dir):
    return jaccard.join(documents(spark, sf_dir))


def _case(name: str, column: str) -> str:
    whens = " ".join(f"WHEN {column} = '{k}' THEN {w}" for k, w in mixing.WEIGHTS[name].items())
    return f"CASE {whens} ELSE 1 END"


def _level(name: str, path: str, parent: str, parents: str, on: str) -> str:
    """One level of the budget, children of ``parent`` (a CTE with ``budget``)."""
    return f"""
{name}_n AS (SELECT {path}, sum(capacity) AS capacity FROM leaf GROUP BY {path}),
{name}_w AS (SELECT n.*, p.budget, CAST({_case(name, 'n.' + name)} AS HUGEINT) AS weight FROM {name}_n n JOIN {parent} p ON {on}),
{name}_o AS (
  SELECT *, coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM {name}_w WINDOW o AS (PARTITION BY {parents} ORDER BY CAST(capacity AS DOUBLE) / CAST(weight AS DOUBLE), {name})),
{name}_f AS (SELECT *, CAST(capacity * rest AS HUGEINT) <= CAST(weight * (budget - prev) AS HUGEINT) AS fullup FROM {name}_o),
{name}_s AS (
  SELECT *, budget - coalesce(sum(capacity) FILTER (fullup) OVER (PARTITION BY {parents}), 0) AS remain,
         sum(weight) FILTER (NOT fullup) OVER (PARTITION BY {parents}) AS openw FROM {name}_f),
{name}_b AS (
  SELECT {path}, CAST(CASE WHEN fullup THEN capacity ELSE CAST(weight * remain AS HUGEINT) // CAST(openw AS HUGEINT) END AS HUGEINT) AS budget
  FROM {name}_s)"""


MIXING_SQL = f"""
WITH raw AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, coalesce(source, 'none') AS source, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) AS k,
         coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) AS tokens, md5(coalesce(source, 'none'))[1] AS h FROM documents),
d AS (
  SELECT *, CASE WHEN h < '5' THEN 'web' WHEN h < '9' THEN 'books' WHEN h < 'd' THEN 'forum' ELSE 'news' END AS domain,
         md5('{mixing.SEED}:' || k)[1:{mixing.DIGITS}] AS bucket FROM raw),
sizes AS (SELECT domain, lang, source, bucket, CAST(sum(tokens) AS HUGEINT) AS tokens FROM d GROUP BY ALL),
leaf AS (
  SELECT domain, lang, source, CAST(sum(tokens) AS HUGEINT) AS tokens, CAST(sum(tokens) * {mixing.EPOCHS} AS HUGEINT) AS capacity
  FROM sizes GROUP BY ALL HAVING sum(tokens) > 0),
root AS (
  SELECT least(CAST(sum(tokens) * {mixing.BUDGET[0]} AS HUGEINT) // {mixing.BUDGET[1]}, CAST(sum(capacity) AS HUGEINT)) AS budget FROM leaf),
{_level('domain', 'domain', 'root', "1", 'TRUE')},
{_level('lang', 'domain, lang', 'domain_b', 'domain', 'n.domain = p.domain')},
{_level('source', 'domain, lang, source', 'lang_b', 'domain, lang', 'n.domain = p.domain AND n.lang = p.lang')},
e AS (
  SELECT l.domain, l.lang, l.source, CAST(b.budget // l.tokens AS BIGINT) AS q, CAST(b.budget % l.tokens AS BIGINT) AS r
  FROM leaf l JOIN source_b b ON l.domain = b.domain AND l.lang = b.lang AND l.source = b.source),
p AS (
  SELECT s.*, e.q, e.r, md5('{mixing.SEED}:' || e.q || ':' || s.bucket) AS place
  FROM sizes s JOIN e ON s.domain = e.domain AND s.lang = e.lang AND s.source = e.source),
x AS (
  SELECT d.doc_id, d.domain, d.lang, d.source, d.tokens, p.q, p.r,
         sum(d.tokens) OVER (PARTITION BY d.domain, d.lang, d.source
                             ORDER BY p.place, md5('{mixing.SEED}:' || p.q || ':' || d.k)) AS upto
  FROM d JOIN p ON d.domain = p.domain AND d.lang = p.lang AND d.source = p.source AND d.bucket = p.bucket)
SELECT doc_id, domain, lang, source, CAST(tokens AS BIGINT) AS tokens, q + CASE WHEN upto <= r THEN 1 ELSE 0 END AS epochs
FROM x WHERE q + CASE WHEN upto <= r THEN 1 ELSE 0 END > 0"""


@query("op5_source_mixing", MIXING_SQL)
def op5(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir)).select(
        "doc_id", F.col("mix_domain").alias("domain"), F.coalesce("lang", F.lit("und")).alias("lang"),
        F.coalesce("source", F.lit("none")).alias("source"), F.col("mix_tokens").alias("tokens"), F.col("mix_epochs").alias("epochs"))


def _crc32(text: str) -> str:
    """crc32 of an ASCII text as an SQL expression, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    step = "lambda x, b: xor(xor(x, b) >> 1, 3988292384 * (xor(x, b) & 1))"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), {step}))"


REPAIR_SQL = rf"""
WITH RECURSIVE
h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
c AS (SELECT *, {_crc32('name')} % 20 AS kind FROM h),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM c, (VALUES (0), (1)) t(again) WHERE kind <> 0 AND (again = 0 OR kind = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS k FROM d),
f AS (
  SELECT *, left(role, 1) AS i,
         CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'd'
              WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 't' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM o),
ins(a, b, cost, edits) AS (VALUES
  (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (1, 2, 2, 'I'), (3, 2, 2, 'I'), (2, 3, 2, 'I'),
  (0, 3, 4, 'II'), (1, 3, 4, 'II'), (2, 2, 4, 'II'), (3, 3, 4, 'II')),
act(e, i, a, b, cost) AS (VALUES
  ('D', '', 0, 0, 3), ('D', '', 1, 1, 3), ('D', '', 2, 2, 3), ('D', '', 3, 3, 3),
  ('K', 's', 0, 1, 0), ('K', 'u', 0, 2, 0), ('K', 'u', 1, 2, 0), ('K', 'u', 3, 2, 0), ('K', 'a', 2, 3, 0),
  ('R', '', 0, 2, 2), ('R', '', 1, 2, 2), ('R', '', 3, 2, 2), ('R', '', 2, 3, 2)),
s(conv_id, k, state, best) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, {{'cost': 0, 'edits': ''}} FROM f
  UNION ALL
  SELECT f.conv_id, f.k, act.b,
         min({{'cost': s.best.cost + ins.cost + act.cost + CASE WHEN act.e <> 'D' AND f.fault = 't' THEN 1 ELSE 0 END,
               'edits': s.best.edits || ins.edits || act.e}})
  FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.k = s.k + 1
       JOIN ins ON ins.a = s.state
       JOIN act ON act.a = ins.b AND (act.e = 'D' OR f.fault NOT IN ('b', 'd') AND (act.e = 'R' OR act.i = f.i))
  GROUP BY f.conv_id, f.k, act.b),
ends(state, cost, edits) AS (VALUES (0, 0, ''), (1, 4, 'II'), (2, 2, 'I'), (3, 0, '')),
n AS (SELECT conv_id, max(k) AS k FROM f GROUP BY conv_id),
best AS (
  SELECT s.conv_id, min({{'cost': s.best.cost + ends.cost, 'edits': s.best.edits || ends.edits}}) AS best
  FROM s JOIN n ON n.conv_id IS NOT DISTINCT FROM s.conv_id AND n.k = s.k JOIN ends ON ends.state = s.state GROUP BY s.conv_id),
chars AS (
  SELECT conv_id, p, substr(best.edits, p, 1) AS e,
         length(replace(substr(best.edits, 1, p), 'I', '')) AS k, length(replace(substr(best.edits, 1, p), 'D', '')) AS j
  FROM (SELECT conv_id, best, unnest(range(1, length(best.edits) + 1)) AS p FROM best)),
kept AS (
  SELECT x.conv_id, x.j, x.e, f.role, f.text, bool_or(x.e = 'K' AND x.j = 1 AND f.i = 's') OVER (PARTITION BY x.conv_id) AS led
  FROM chars x LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.k = x.k AND x.e <> 'I' WHERE x.e <> 'D'),
told AS (
  SELECT conv_id, sha256(string_agg(
           CASE WHEN e = 'K' THEN role WHEN (j + CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END
           || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS digest
  FROM kept GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b.best.cost, 0) AS BIGINT) AS cost,
       coalesce(b.best.edits, '') AS audit, coalesce(told.digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM e.conv_id"""


@query("op11_structure_repair", REPAIR_SQL)
def op11(spark, sf_dir):
    return repair.repair_damaged(documents(spark, sf_dir, "conversations"))


def _leaf(n_chars: str = "n_chars") -> str:
    """Hash of a documents row."""
    fields = [f"coalesce(octet_length(encode(CAST({f} AS VARCHAR))) || ':' || {f}, '-')"
              for f in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256({' || '.join(fields)})"


MANIFEST_SQL = f"""
WITH RECURSIVE
d AS (
  SELECT doc_id, lang, coalesce('=' || lang, '') AS g, {_leaf()} AS leaf,
         CASE WHEN {_crc32("coalesce(CAST(doc_id AS VARCHAR), '')")} % 7 = 0 AND doc_id IS NOT NULL THEN {_leaf('(n_chars + 1)')} END AS altered
  FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
low(g, level, pos, h, n) AS (
  SELECT g, 0, pos, leaf, count(*) OVER (PARTITION BY g) FROM p
  UNION ALL
  SELECT g, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM low WHERE n > 1
  GROUP BY g, level, pos // 2, n),
sub AS (SELECT g, level AS height, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos FROM low WHERE n = 1),
high(level, pos, h, n) AS (
  SELECT 0, pos, subroot, count(*) OVER () FROM sub
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM high WHERE n > 1 GROUP BY level, pos // 2, n),
sib AS (
  SELECT p.g, p.pos, x.level, x.h, p.pos >> x.level AS here FROM p JOIN low x ON x.g = p.g AND x.n > 1 AND x.pos = xor(p.pos >> x.level, 1)
  UNION ALL
  SELECT p.g, p.pos, s.height + x.level, x.h, s.pos >> x.level FROM p JOIN sub s ON s.g = p.g
  JOIN high x ON x.n > 1 AND x.pos = xor(s.pos >> x.level, 1)),
proof AS (SELECT g, pos, sha256(string_agg(h, '' ORDER BY level)) AS proof FROM sib GROUP BY g, pos),
fold(g, pos, level, h) AS (
  SELECT g, pos, 0, coalesce(altered, leaf) FROM p
  UNION ALL
  SELECT f.g, f.pos, f.level + 1, sha256(CASE WHEN sib.here % 2 = 1 THEN coalesce(sib.h, '') || f.h ELSE f.h || coalesce(sib.h, '') END)
  FROM fold f JOIN sub ON sub.g = f.g LEFT JOIN sib ON sib.g = f.g AND sib.pos = f.pos AND sib.level = f.level
  WHERE f.level < sub.height + (SELECT max(level) FROM high))
SELECT p.doc_id, p.leaf, sub.subroot, r.h AS root, coalesce(proof.proof, sha256('')) AS proof_sha256, fold.h AS folded_root,
       fold.h = r.h AS verified
FROM p JOIN sub ON sub.g = p.g JOIN (SELECT h FROM high WHERE n = 1) r ON TRUE
LEFT JOIN proof ON proof.g = p.g AND proof.pos = p.pos
JOIN fold ON fold.g = p.g AND fold.pos = p.pos AND fold.level = sub.height + (SELECT max(level) FROM high)"""


@query("op13_merkle_manifest", MANIFEST_SQL)
def op13(spark, sf_dir):
    return manifest.digest(documents(spark, sf_dir))


@query("op12_setsketch_duplicates", r"""
WITH RECURSIVE
w AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS words FROM documents),
u AS (SELECT r, len(words) AS m, unnest(words) AS a, generate_subscripts(words, 1) AS p FROM w),
v AS (
  SELECT r, m, p, hash(a, lead(a) OVER o, lead(a, 2) OVER o, lead(a, 3) OVER o, lead(a, 4) OVER o) AS gram
  FROM u WINDOW o AS (PARTITION BY r ORDER BY p)),
x AS (SELECT r, list_sort(list(DISTINCT gram)) AS grams FROM v WHERE p <= greatest(m - 4, 1) GROUP BY r),
g AS (SELECT w.r, w.doc_id, coalesce(x.grams, []) AS grams FROM w LEFT JOIN x ON x.r = w.r),
s AS (SELECT DISTINCT hash(grams) AS node, len(grams) AS n, grams FROM g WHERE len(grams) > 0),
e AS (SELECT node, n, unnest(grams) AS gram FROM s),
l AS (
  SELECT a.node AS a, b.node AS b FROM e a JOIN e b ON a.gram = b.gram AND a.node <> b.node AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
t AS (SELECT DISTINCT node, node AS reached FROM s UNION SELECT t.node, l.b FROM t JOIN l ON l.a = t.reached),
m AS (SELECT hash(grams) AS node, min(doc_id) AS least FROM g WHERE len(grams) > 0 GROUP BY 1),
c AS (SELECT t.node, min(m.least) AS component_id FROM t JOIN m ON m.node = t.reached GROUP BY t.node)
SELECT g.doc_id, CAST(len(g.grams) AS BIGINT) AS n_shingles,
       CASE WHEN len(g.grams) = 0 THEN g.doc_id ELSE c.component_id END AS component_id,
       coalesce(len(g.grams) = 0 OR g.doc_id = c.component_id, c.component_id IS NULL) AS kept
FROM g LEFT JOIN c ON c.node = hash(g.grams) AND len(g.grams) > 0""")
def op12(spark, sf_dir):
    return setsketch.near_duplicates(documents(spark, sf_dir))
