"""The reference queries over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sessionloom.functions import redaction, schema, similarity, text
from sessionloom.functions.globs import denied
from sessionloom.operators import context, curate, evaluate, extract, normalize, review, salience, stats, trace
from sessionloom.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_B = """b AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, event_id, event_type, ts, value,
  event_type = 'error' AS is_error, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""
_ERR = """err AS (SELECT session_id, greatest(idx - 1, 0) AS s, least(idx + 1, last) AS e, 'error' AS reason, 'error ' || event_id AS signal, idx AS ord
  FROM (SELECT *, max(idx) OVER (PARTITION BY session_id) AS last FROM b) WHERE is_error)"""
_TRANS = """ev AS (SELECT session_id, idx, k % 10 AS test, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS kind FROM b WHERE event_type IN ('error', 'purchase')),
g AS (SELECT *, coalesce(sum(kind) OVER (PARTITION BY session_id, test ORDER BY idx, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM ev),
tr AS (SELECT session_id, min(CASE WHEN kind = 0 THEN idx END) AS s, max(CASE WHEN kind = 1 THEN idx END) AS e, 'test_transition' AS reason, CAST(test AS VARCHAR) AS signal, max(CASE WHEN kind = 1 THEN idx END) * 1048576 + 1125899906842624 AS ord
  FROM g GROUP BY session_id, test, grp HAVING s IS NOT NULL AND e IS NOT NULL AND e - s + 1 <= 6)"""


def _merged(raw: str) -> str:
    return f"""raw AS ({raw}),
isl AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY s, e, ord ROWS UNBOUNDED PRECEDING) AS island FROM
  (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY session_id ORDER BY s, e, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 WHEN row_number() OVER (PARTITION BY session_id ORDER BY s, e, ord) = 1 THEN 1 ELSE 0 END AS fresh FROM raw)),
merged AS (SELECT session_id, min(s) AS span_start, max(e) AS span_end, arg_min(reason, row_ord) AS reason, arg_min(signal, row_ord) AS signal FROM
  (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY s, e, ord) AS row_ord FROM isl) GROUP BY session_id, island)"""


def _spans(rows: DataFrame) -> DataFrame:
    return rows.select("session_id", F.col("start").cast("long").alias("span_start"), F.col("end").cast("long").alias("span_end"), "reason", "signal")


@query(f"WITH {_B}, {_ERR}, {_merged('SELECT * FROM err')} SELECT * FROM merged")
def spans_error_merged(spark, d):
    return _spans(salience.merge_spans(salience.error_spans(views.event_turns(spark, d))))


@query(f"WITH {_B}, {_TRANS} SELECT session_id, s AS span_start, e AS span_end, reason, signal FROM tr")
def spans_test_transition(spark, d):
    return _spans(salience.transition_spans(views.test_events(views.event_turns(spark, d))))


@query(f"""WITH {_B}, {_ERR}, {_TRANS}, ph AS (SELECT session_id, idx AS s, idx AS e, CASE WHEN event_type = 'signup' THEN 'retry' ELSE 'reversal' END AS reason, event_type AS signal, idx + 4294967296 AS ord FROM b WHERE event_type IN ('signup', 'view')),
{_merged('SELECT * FROM err UNION ALL SELECT * FROM ph UNION ALL SELECT * FROM tr')} SELECT * FROM merged""")
def spans_all_merged(spark, d):
    turns = views.event_turns(spark, d)
    return _spans(salience.salient_spans(turns, views.test_events(turns), retry=("signup",), reversal=("view",)))


_RETRY, _REVERSAL = ("the the",), ("and and",)
_PH = """ph AS (SELECT conv_id AS session_id, turn AS s, turn AS e, CASE WHEN contains(lower(text), 'the the') THEN 'retry' ELSE 'reversal' END AS reason,
  CASE WHEN contains(lower(text), 'the the') THEN substr(text, strpos(lower(text), 'the the'), 7) ELSE substr(text, strpos(lower(text), 'and and'), 7) END AS signal, turn AS ord
  FROM conversations WHERE contains(lower(text), 'the the') OR contains(lower(text), 'and and'))"""


@query(f"WITH {_PH} SELECT session_id, s AS span_start, e AS span_end, reason, signal FROM ph")
def spans_phrase(spark, d):
    return _spans(salience.phrase_spans(views.talk_turns(spark, d), _RETRY, _REVERSAL))


@query("SELECT conv_id AS session_id, count(*) AS n_turns FROM conversations GROUP BY conv_id HAVING count(*) >= 4 AND bool_or(contains(lower(text), 'the the') OR contains(lower(text), 'and and'))")
def reflectable_sessions(spark, d):
    return salience.reflectable(views.talk_turns(spark, d), 4, retry=_RETRY, reversal=_REVERSAL)


_EXC = f"""WITH {_PH}, {_merged('SELECT * FROM ph')}, n AS (SELECT conv_id AS session_id, max(turn) + 1 AS n FROM conversations GROUP BY conv_id),
gap AS (SELECT session_id, p0, span_start - p0 AS omitted FROM (SELECT *, coalesce(lag(span_end) OVER (PARTITION BY session_id ORDER BY span_start) + 1, 0) AS p0 FROM merged)
  UNION ALL SELECT session_id, max(span_end) + 1, any_value(n) - max(span_end) - 1 FROM merged JOIN n USING (session_id) GROUP BY session_id)"""


@query(_EXC + "SELECT session_id, p0 AS \"at\", omitted FROM gap WHERE omitted > 0")
def gap_markers(spark, d):
    turns = views.talk_turns(spark, d)
    return salience.gaps(salience.merge_spans(salience.phrase_spans(turns, _RETRY, _REVERSAL)), turns)


@query(_EXC + """, piece AS (SELECT session_id, turn AS p0, '[' || turn || '] ' || role || ': ' || text AS p FROM conversations JOIN merged ON conv_id = session_id AND turn BETWEEN span_start AND span_end
  UNION ALL SELECT session_id, p0, '[... ' || omitted || ' turns omitted ...]' FROM gap WHERE omitted > 0)
SELECT session_id, sha256(string_agg(p, chr(10) ORDER BY p0)) AS excerpt_sha256 FROM piece GROUP BY session_id""")
def excerpt_render(spark, d):
    turns = views.talk_turns(spark, d)
    rows = salience.excerpts(salience.merge_spans(salience.phrase_spans(turns, _RETRY, _REVERSAL)), turns, salience.render_turn())
    return rows.select("session_id", F.sha2("excerpt", 256).alias("excerpt_sha256"))


@query(f"WITH {_B} SELECT session_id, CASE WHEN arg_max(is_error, idx) FILTER (event_type IN ('error', 'purchase')) THEN 'error' ELSE 'completed' END AS outcome FROM b GROUP BY session_id")
def turn_outcome(spark, d):
    return normalize.outcomes(views.event_turns(spark, d).withColumn("has_result", F.col("event_type").isin("error", "purchase")))


@query("SELECT user_id AS session, min(ts) AS started_at, max(ts) AS ended_at FROM events GROUP BY user_id")
def session_bounds(spark, d):
    rows = normalize.bounds(views.table(spark, d, "events").select(F.col("user_id").alias("session"), "ts"), F.lit(None).cast("timestamp_ntz"))
    return rows.select("session", "started_at", "ended_at")


@query(f"""WITH {_B} SELECT r.event_id, coalesce('click ' || max(u.event_id), 'tool') AS name FROM b r LEFT JOIN b u ON u.session_id = r.session_id AND u.k % 10 = r.k % 10 AND u.event_type = 'click' AND u.idx < r.idx
WHERE r.event_type = 'purchase' GROUP BY r.event_id""".replace("'click ' || max(u.event_id)", "'click ' || arg_max(u.event_id, u.idx)"))
def asof_tool_lookup(spark, d):
    rows = views.event_turns(spark, d).filter("event_type in ('click', 'purchase')")
    name = normalize.asof_name(F.col("event_type") == "click", F.concat(F.lit("click "), F.col("event_id").cast("string")), ["session_id", "test"], ["idx"])
    return rows.withColumn("name", name).filter("event_type = 'purchase'").select("event_id", "name")


def _errors(spark, d) -> DataFrame:
    turns = views.event_turns(spark, d).filter("is_error")
    return turns.select("session_id", F.concat(F.lit(" failed test "), F.col("test").cast("string"), F.lit(" in click.py ")).alias("error"), F.col("idx").alias("ord"))


_FE = f"WITH {_B}, fe AS (SELECT session_id, 'failed test ' || k % 10 || ' in click.py' AS error, min(idx) AS ord FROM b WHERE is_error GROUP BY ALL)"


@query(_FE + "SELECT * FROM fe")
def first_seen_errors(spark, d):
    return extract.first_errors(_errors(spark, d))


def _diffs(spark, d) -> DataFrame:
    turns = views.event_turns(spark, d).filter("event_type != 'error'")
    return turns.select("session_id", F.concat("event_type", F.lit(".py")).alias("file"), F.col("idx").alias("ord"))


@query(f"WITH {_B} SELECT session_id, event_type || '.py' AS file, min(idx) AS ord FROM b WHERE NOT is_error GROUP BY ALL")
def touched_distinct(spark, d):
    return extract.touched_files(_diffs(spark, d))


@query(_FE + f", diff AS (SELECT session_id, event_type || '.py' AS file, min(idx) AS p0 FROM b WHERE NOT is_error GROUP BY ALL) SELECT fe.session_id, error, string_agg(file, ',' ORDER BY p0) AS files FROM fe JOIN diff ON fe.session_id = diff.session_id AND contains(lower(error), lower(file)) GROUP BY ALL")
def related_files(spark, d):
    rows = extract.related_files(extract.first_errors(_errors(spark, d)), extract.touched_files(_diffs(spark, d)))
    return rows.select("session_id", "error", F.array_join("files", ",").alias("files"))


@query(_FE + """, diff AS (SELECT DISTINCT session_id FROM b WHERE event_type = 'click'),
r AS (SELECT fe.*, diff.session_id IS NOT NULL AS has, row_number() OVER (PARTITION BY fe.session_id ORDER BY ord) AS n FROM fe LEFT JOIN diff USING (session_id))
SELECT session_id, ord, 'gotcha-' || substr(sha256(session_id || ':' || error), 1, 6) AS id, error AS title, CASE WHEN has THEN 'click.py' ELSE '' END AS scope,
  sha256('## What happens' || chr(10) || chr(10) || error || chr(10) || chr(10) || '## What to do' || chr(10) || chr(10) || CASE WHEN has THEN 'Review the changes below, made in the same session, for the likely cause:' || chr(10) || chr(10) || '- click.py' ELSE 'Investigate the error above; no diff in this session touched a related file.' END || chr(10)) AS body_sha256
FROM r WHERE n <= 3""")
def top_k_candidates(spark, d):
    rows = extract.rule_candidates(_errors(spark, d), extract.touched_files(_diffs(spark, d)))
    return rows.select("session_id", "ord", "id", "title", F.array_join("scope", ",").alias("scope"), F.sha2("body", 256).alias("body_sha256"))


@query("SELECT doc_id, 'fact-' || substr(sha256(text), 1, 6) AS id FROM documents")
def entry_ids(spark, d):
    return views.table(spark, d, "documents").select("doc_id", text.entry_id(F.lit("fact"), F.col("text")).alias("id"))


@query("SELECT doc_id, sha256(text) AS excerpt_sha256 FROM documents")
def excerpt_sha256(spark, d):
    return views.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("excerpt_sha256"))


_T = r"""t AS (SELECT *, CASE WHEN length(line) > 100 THEN regexp_replace(substr(line, 1, 99), '\s+$', '') || '…' WHEN line = '' THEN 'Unspecified error' ELSE line END AS title FROM
  (SELECT *, regexp_replace(split_part(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10), 1), '^\s+|\s+$', '', 'g') AS line FROM documents))"""


@query(f"WITH {_T} SELECT doc_id, title FROM t")
def title_from_error(spark, d):
    return views.titled(spark, d).select("doc_id", "title")


@query(f"""WITH {_T}, i AS (SELECT doc_id, 'fact-' || substr(sha256(text), 1, 6) AS id, coalesce(nullif(array_to_string(list_filter(string_split(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')[1:6], '-'), ''), 'entry') AS slug FROM t)
SELECT doc_id, slug, '2024-01-02-' || slug || '-' || substr(id, 6, 4) || '.md' AS path FROM i""")
def slug_path(spark, d):
    rows = views.titled(spark, d).withColumn("id", text.entry_id(F.lit("fact"), F.col("text")))
    return rows.select("doc_id", text.slug(F.col("title")).alias("slug"), text.entry_file(F.lit("2024-01-02").cast("date"), F.col("title"), F.col("id")).alias("path"))


@query(r"""SELECT doc_id, sha256(coalesce(list_filter(list_transform(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10) || chr(10)), lambda x: regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^ | $', '', 'g')), lambda x: x <> '' AND NOT starts_with(x, '#'))[1], '')) AS paragraph_sha256 FROM documents""")
def first_paragraph(spark, d):
    return views.table(spark, d, "documents").select("doc_id", F.sha2(text.first_paragraph(F.col("text")), 256).alias("paragraph_sha256"))


_WORDS = r"""list_distinct(list_filter(list_transform(string_split(regexp_replace(regexp_replace(lower({0}), '\s+', ' ', 'g'), '^ | $', '', 'g'), ' '), lambda x: trim(x, '!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~')), lambda x: x <> ''))"""


@query(f"WITH {_T} SELECT doc_id, array_to_string(list_sort({_WORDS.format('title')}), ' ') AS words FROM t")
def title_words(spark, d):
    return views.titled(spark, d).select("doc_id", F.array_join(F.array_sort(text.title_words(F.col("title"))), " ").alias("words"))


_NAMES = "names AS (SELECT DISTINCT p_name AS title FROM part)"
_OVER = f"CASE WHEN contains(lower(a), lower(b)) OR contains(lower(b), lower(a)) THEN 1.0 ELSE round(len(list_intersect({_WORDS.format('a')}, {_WORDS.format('b')})) / least(len({_WORDS.format('a')}), len({_WORDS.format('b')})), 6) END"


def _names(spark, d) -> DataFrame:
    return views.table(spark, d, "part").select(F.col("p_name").alias("title")).distinct()


@query(f"WITH {_NAMES} SELECT a, b, CAST({_OVER} AS DOUBLE) AS score FROM (SELECT x.title AS a, y.title AS b FROM names x, names y) WHERE {_OVER} >= 0.5")
def title_overlap_pairs(spark, d):
    names = _names(spark, d)
    return similarity.title_pairs(names, names, 0.5).select("a", "b", F.round("score", 6).alias("score"))


@query("""WITH n AS (SELECT DISTINCT p_name AS title, string_split(p_name, ' ') AS tags, unnest(string_split(p_name, ' ')) AS tag FROM part)
SELECT a, b, round(k / least(na, nb), 6) AS overlap FROM (SELECT x.title AS a, y.title AS b, count(DISTINCT x.tag) AS k, any_value(len(list_distinct(x.tags))) AS na, any_value(len(list_distinct(y.tags))) AS nb FROM n x JOIN n y USING (tag) GROUP BY ALL)""")
def tag_overlap_pairs(spark, d):
    rows = _names(spark, d).withColumn("tags", F.split("title", " "))
    one = rows.select(F.col("title").alias("a"), F.col("tags").alias("ta"), F.explode("tags").alias("tag"))
    two = rows.select(F.col("title").alias("b"), F.col("tags").alias("tb"), F.explode("tags").alias("tag"))
    pairs = one.join(two, "tag").drop("tag").distinct()
    return pairs.select("a", "b", F.round(similarity.tag_overlap(F.col("ta"), F.col("tb")), 6).alias("overlap"))


@query("""WITH e AS (SELECT DISTINCT p_type, p_name, p_brand FROM part) SELECT x.p_type AS type, x.p_name AS a, y.p_name AS b, count(DISTINCT x.p_brand) AS shared FROM e x JOIN e y ON x.p_type = y.p_type AND x.p_brand = y.p_brand AND x.p_name < y.p_name GROUP BY ALL""")
def scope_overlap_pairs(spark, d):
    rows = views.part_entries(spark, d).select("type", "title", F.explode("scope").alias("pattern")).distinct()
    one, two = rows.withColumnRenamed("title", "a"), rows.withColumnRenamed("title", "b")
    return one.join(two, ["type", "pattern"]).filter("a < b").groupBy("type", "a", "b").agg(F.count(F.lit(1)).alias("shared"))


_LCS = """list_reduce(string_split({a}, ''), lambda prev, c: list_reduce(range(1, length({b}) + 1), lambda r, j: list_append(r, CASE WHEN substr({b}, j, 1) = c THEN prev[j] + 1 ELSE greatest(prev[j + 1], r[j]) END), [0::BIGINT]), list_transform(range(0, length({b}) + 1), lambda i: 0::BIGINT))[length({b}) + 1]"""
_SORTED = "array_to_string(list_sort(string_split({0}, ' ')), ' ')"
_RATIO = f"""ratios AS (SELECT a, b, 200.0 * ({_LCS.format(a='sa', b='sb')}) / (length(sa) + length(sb)) AS ratio FROM
  (SELECT x.title AS a, y.title AS b, {_SORTED.format('x.title')} AS sa, {_SORTED.format('y.title')} AS sb FROM names x, names y))"""


@query(f"WITH {_NAMES}, {_RATIO} SELECT a, b, round(ratio, 6) AS ratio FROM ratios WHERE ratio >= 72")
def indel_ratio_pairs(spark, d):
    names = _names(spark, d)
    return curate.title_ratios(names, names, curate.TITLE_FLOOR).select("a", "b", F.round("ratio", 6).alias("ratio"))


def _curation(spark, d):
    """The distinct part names as a batch of candidates against approved, staged and rejected ones."""
    parts = views.part_entries(spark, d)
    by = parts.groupBy("title").agg(F.min("id").alias("id"), F.min("seq").alias("seq"), F.min_by("type", "seq").alias("type"), F.min_by("tags", "seq").alias("tags"), F.min_by("body", "seq").alias("body"), F.min_by("size", "seq").alias("size"))
    by = by.withColumn("scope", F.array(F.when(F.col("size") % 2 == 0, "src/**").otherwise("lib/**")))
    by = by.withColumn("file_name", F.concat(text.slug(F.col("title")), F.lit("-"), F.col("id"))).withColumn("type_ord", F.length("type")).withColumn("excerpt_sha256", F.sha2("title", 256))
    approved, staged = by.filter("size > 35"), by.filter("size between 21 and 35")
    stones = by.filter("size <= 4 or size between 18 and 20").select("id", "title", F.lit("old").alias("reason"), "excerpt_sha256")
    return by.filter("size between 5 and 20"), approved, staged, stones


_CUR = f"""{_NAMES}, {_RATIO}, by0 AS (SELECT p_name AS title, printf('part-%06d', min(p_partkey)) AS id, min(p_partkey) AS seq, arg_min(p_type, p_partkey) AS type, arg_min(p_brand, p_partkey) AS brand, arg_min(p_size, p_partkey) AS size FROM part GROUP BY p_name),
by1 AS (SELECT *, array_to_string(string_split(title, ' '), '-') || '-' || id AS file_name, length(type) AS type_ord FROM by0),
cand AS (SELECT * FROM by1 WHERE size BETWEEN 5 AND 20),
stone AS (SELECT * FROM by1 WHERE size <= 4 OR size BETWEEN 18 AND 20),
ov AS (SELECT a, b FROM (SELECT x.title AS a, y.title AS b FROM cand x, stone y) WHERE {_OVER} >= 0.6),
dead AS (SELECT DISTINCT id FROM cand WHERE title IN (SELECT a FROM ov)),
rest AS (SELECT * FROM cand WHERE id NOT IN (SELECT id FROM dead)),
pool AS (SELECT id, title, size, 0 AS peer, type_ord, file_name, -1 AS before FROM by1 WHERE size > 35 UNION ALL SELECT id, title, size, 1, 0, file_name, -1 FROM by1 WHERE size BETWEEN 21 AND 35 UNION ALL SELECT id, title, size, 1, 0, file_name, seq FROM rest),
dup AS (SELECT r.id, arg_min(p.id, (p.peer, p.type_ord, p.file_name)) AS match FROM rest r JOIN pool p ON p.id <> r.id AND p.before < r.seq JOIN ratios ON ratios.a = r.title AND ratios.b = p.title
  JOIN bodies ON bodies.a = r.title AND bodies.b = p.title WHERE ratios.ratio >= 88 OR (ratios.ratio >= 72 AND bodies.ratio >= 75) GROUP BY r.id),
contra AS (SELECT r.id, arg_min(p.id, (p.type_ord, p.file_name)) AS match FROM rest r JOIN by1 p ON p.size > 35 AND p.type = r.type AND p.size % 2 = r.size % 2 JOIN ratios ON ratios.a = r.title AND ratios.b = p.title
  WHERE ratios.ratio < 88 AND len(list_intersect(string_split(r.title, ' '), string_split(p.title, ' '))) >= 0.5 * least(len(string_split(r.title, ' ')), len(string_split(p.title, ' '))) GROUP BY r.id)"""
_BODIES = f"""bodies AS (SELECT a, b, 200.0 * ({_LCS.format(a='sa', b='sb')}) / (length(sa) + length(sb)) AS ratio FROM
  (SELECT x.title AS a, y.title AS b, {_SORTED.format("(x.title || ' ' || x.size)")} AS sa, {_SORTED.format("(y.title || ' ' || y.size)")} AS sb FROM by1 x, by1 y))"""
_CUR = _CUR.replace("cand AS (", _BODIES + ",\ncand AS (", 1)


@query(f"WITH {_CUR} SELECT id FROM rest")
def tombstone_antijoin(spark, d):
    cand, _, _, stones = _curation(spark, d)
    return cand.join(curate.tombstoned(cand, stones), "id", "left_anti").select("id")


@query(f"WITH {_CUR} SELECT id, match FROM dup")
def near_duplicates(spark, d):
    cand, approved, staged, stones = _curation(spark, d)
    done = curate.outcomes(cand, approved, staged, stones)
    return done.filter("outcome = 'amendment'").select("id", "match")


@query(f"WITH {_CUR} SELECT id, match FROM contra")
def contradictions(spark, d):
    cand, approved, _, stones = _curation(spark, d)
    rest = cand.join(curate.tombstoned(cand, stones), "id", "left_anti")
    return curate.contradictions(rest, approved.withColumn("order_key", F.struct("type_ord", "file_name")))


@query(f"""WITH {_CUR} SELECT c.id, CASE WHEN d.id IS NOT NULL THEN 'dropped' WHEN u.id IS NOT NULL THEN 'amendment' WHEN x.id IS NOT NULL THEN 'supersession' ELSE 'new' END AS outcome, CASE WHEN d.id IS NULL THEN coalesce(u.match, x.match) END AS match
FROM cand c LEFT JOIN dead d USING (id) LEFT JOIN dup u USING (id) LEFT JOIN contra x USING (id)""")
def curation_outcomes(spark, d):
    return curate.outcomes(*_curation(spark, d))


@query(f"""WITH {_CUR} SELECT count(*) FILTER (id NOT IN (SELECT id FROM dead)) AS staged, count(*) FILTER (id IN (SELECT id FROM dead)) AS dropped FROM cand""")
def reflect_summary(spark, d):
    return stats.outcome_counts(curate.outcomes(*_curation(spark, d)))


@query(f"WITH {_NAMES}, c AS (SELECT DISTINCT p_name AS a FROM part WHERE p_size > 25), k AS (SELECT DISTINCT p_name AS b FROM part WHERE p_size = 1) SELECT a AS title FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE {_OVER} >= 0.6)")
def non_redundant(spark, d):
    parts = views.table(spark, d, "part")
    pick = lambda q: parts.filter(q).select(F.col("p_name").alias("title")).distinct()
    return evaluate.non_redundant(pick("p_size > 25"), pick("p_size = 1"))


def _fixtures(spark, d):
    rows = views.part_entries(spark, d).select(F.col("scope")[0].alias("fixture"), "title", F.col("seq").alias("pos"), "size")
    by = rows.groupBy("fixture", "title").agg(F.min("pos").alias("pos"), F.min_by("size", "pos").alias("size"))
    return by.filter("size <= 25").select("fixture", "pos", "title"), by.filter("size > 25").select("fixture", "pos", "title")


_FIX = f"""f AS (SELECT p_brand AS fixture, p_name AS title, min(p_partkey) AS pos, arg_min(p_size, p_partkey) AS size FROM part GROUP BY ALL),
pairs AS (SELECT fixture, cand, gold, {_OVER} AS score FROM (SELECT x.fixture, x.pos AS cand, x.title AS a, y.pos AS gold, y.title AS b FROM f x JOIN f y ON x.fixture = y.fixture AND x.size <= 25 AND y.size > 25)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY fixture ORDER BY score DESC, cand, gold) AS rn FROM pairs WHERE score >= 0.6),
walk AS (SELECT fixture, 0 AS rn, []::BIGINT[] AS cs, []::BIGINT[] AS gs, false AS took FROM (SELECT DISTINCT fixture FROM ranked)
  UNION ALL SELECT r.fixture, r.rn, CASE WHEN list_contains(cs, r.cand) OR list_contains(gs, r.gold) THEN cs ELSE list_append(cs, r.cand) END, CASE WHEN list_contains(cs, r.cand) OR list_contains(gs, r.gold) THEN gs ELSE list_append(gs, r.gold) END, NOT (list_contains(cs, r.cand) OR list_contains(gs, r.gold))
  FROM walk JOIN ranked r ON r.fixture = walk.fixture AND r.rn = walk.rn + 1),
m AS (SELECT r.fixture, r.cand, r.gold, round(CAST(r.score AS DOUBLE), 6) AS score FROM walk JOIN ranked r USING (fixture, rn) WHERE took)"""


@query(f"WITH RECURSIVE {_FIX} SELECT * FROM m")
def gold_matches(spark, d):
    cand, gold = _fixtures(spark, d)
    return evaluate.gold_matches(cand, gold).withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE {_FIX}, c AS (SELECT x.fixture, x.pos, x.title, m.cand IS NOT NULL AS matched, x.size % 2 = 0 AS passed,
  EXISTS (SELECT 1 FROM (SELECT x.title AS a, y.title AS b FROM f y WHERE y.fixture = x.fixture AND y.size <= 25 AND y.pos < x.pos) WHERE {_OVER} >= 0.6) AS duplicate FROM f x LEFT JOIN m ON m.fixture = x.fixture AND m.cand = x.pos WHERE x.size <= 25)
SELECT count(*) AS candidates, (SELECT count(*) FROM f WHERE size > 25) AS gold, 0::BIGINT AS judge_errors, 1.0::DOUBLE AS schema_validity, round(count(*) FILTER (matched AND passed) / count(*), 6) AS precision, round(count(*) FILTER (matched) / (SELECT count(*) FROM f WHERE size > 25), 6) AS recall, round(count(*) FILTER (duplicate) / count(*), 6) AS duplicate_rate, round(count(*) FILTER (passed) / count(*), 6) AS pass_rate FROM c""")
def eval_summary(spark, d):
    cand, gold = _fixtures(spark, d)
    sizes = views.table(spark, d, "part").select(F.col("p_partkey").alias("pos"), (F.col("p_size") % 2 == 0).alias("passed"))
    hits = evaluate.gold_matches(cand, gold).select("fixture", F.col("cand").alias("pos"), F.lit(True).alias("matched"))
    twice = evaluate.repeats_earlier(cand).withColumn("duplicate", F.lit(True))
    rows = cand.join(sizes, "pos").join(hits, ["fixture", "pos"], "left").join(twice, ["fixture", "pos"], "left")
    rows = rows.select(F.lit(True).alias("valid"), F.coalesce("matched", F.lit(False)).alias("matched"), "passed", F.coalesce("duplicate", F.lit(False)).alias("duplicate"), F.lit(False).alias("judge_error"))
    return evaluate.summary(rows, gold)


_ASSIGN = r"(?i)\b(?:api[_-]?key|secret|token|passwd|password|pwd|auth)\s*[:=]\s*[\"'']?[A-Za-z0-9_\-./+=]{12,}"


@query(f"SELECT doc_id, sha256(regexp_replace(text, '{_ASSIGN}', '[REDACTED:assignment]', 'g')) AS redacted_sha256 FROM documents WHERE regexp_matches(text, '{_ASSIGN}')")
def redact_assignment(spark, d):
    pattern = dict(redaction.PATTERNS)["assignment"]
    rows = views.table(spark, d, "documents").filter(F.col("text").rlike(pattern))
    return rows.select("doc_id", F.sha2(F.regexp_replace("text", pattern, "[REDACTED:assignment]"), 256).alias("redacted_sha256"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{_ASSIGN}')) AS n_assignment, len(regexp_extract_all(text, 'AKIA[0-9A-Z]{{16}}')) AS n_aws FROM documents")
def redact_named(spark, d):
    done = redaction.redactor()(F.col("text"))
    rows = views.table(spark, d, "documents").select("doc_id", done.alias("r"))
    n = lambda name: F.size(F.split("r", rf"\[REDACTED:{name}\]")).cast("long") - 1
    return rows.select("doc_id", n("assignment").alias("n_assignment"), n("aws-key-id").alias("n_aws"))


_TOKENS = "tok AS (SELECT DISTINCT regexp_extract(url, '[^/]*$') AS token FROM pages UNION SELECT DISTINCT replace(props, ' ', '') FROM events UNION SELECT DISTINCT sha256(CAST(p_partkey AS VARCHAR)) FROM part UNION SELECT DISTINCT p_type || '/' || p_name || '.py' FROM part UNION SELECT DISTINCT p_brand || sha256(p_name) FROM part)"


def _tokens(spark, d) -> DataFrame:
    t = lambda n: views.table(spark, d, n)
    rows = t("pages").select(F.regexp_extract("url", "[^/]*$", 0).alias("token")).union(t("events").select(F.replace("props", F.lit(" "), F.lit("")))).union(t("part").select(F.sha2(F.col("p_partkey").cast("string"), 256)))
    return rows.union(t("part").select(F.concat("p_type", F.lit("/"), "p_name", F.lit(".py")))).union(t("part").select(F.concat("p_brand", F.sha2("p_name", 256)))).distinct()


@query(f"WITH {_TOKENS}, c AS (SELECT token, ch, count(*) / length(token) AS p FROM (SELECT token, unnest(string_split(token, '')) AS ch FROM tok WHERE token <> '') GROUP BY token, ch) SELECT token, round(-sum(p * log2(p)), 6) + 0.0 AS entropy FROM c GROUP BY token")
def entropy_tokens(spark, d):
    return _tokens(spark, d).filter("token != ''").select("token", (F.round(redaction.entropy(F.col("token")), 6) + 0.0).alias("entropy"))


_SAFE = "|".join(f"(?:{s})" for s in redaction.SAFE_SHAPES)


@query(f"""WITH {_TOKENS}, fl AS (SELECT token, regexp_matches(token, '[a-z]')::INT + regexp_matches(token, '[A-Z]')::INT + regexp_matches(token, '[0-9]')::INT AS classes,
  regexp_matches(token, '{redaction.ALPHABET}') AS plain, regexp_matches(token, '{_SAFE}') AND length(regexp_replace(token, '[^0-9]', '', 'g')) / length(token) < 0.3 AS shaped,
  regexp_matches(token, '[\\\\/]') AND len(list_filter(regexp_split_to_array(token, '[\\\\/]+'), lambda x: x <> '')) >= 2 AND len(list_filter(regexp_split_to_array(token, '[\\\\/]+'), lambda x: x <> '' AND NOT regexp_matches(x, '{redaction.SEGMENT}'))) = 0 AND (regexp_matches(token, '^(?:[A-Za-z]:[\\\\/]|[.~]{{0,2}}[\\\\/])') OR regexp_matches(token, '{redaction.EXTENSION}')) AS path FROM tok WHERE token <> '')
SELECT token, classes, NOT plain OR path OR shaped AS safe, length(token) >= 24 AND NOT (NOT plain OR path OR shaped) AND classes >= 2 AS secret FROM fl""")
def secret_shape_flags(spark, d):
    t = F.col("token")
    return _tokens(spark, d).filter("token != ''").select("token", redaction.character_classes(t).alias("classes"), redaction.is_structurally_safe(t).alias("safe"), redaction.looks_like_secret(t).alias("secret"))


_PATH = "regexp_replace(url, '^[a-z]+://[^/]*/?', '')"


@query(f"SELECT page_id, {_PATH} AS path FROM pages WHERE NOT regexp_matches({_PATH}, '^en/.*$') AND NOT regexp_matches(regexp_extract({_PATH}, '[^/]*$'), '^[^/]*7[^/]*$')")
def deny_glob_filter(spark, d):
    rows = views.table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]*/?", "").alias("path"))
    return rows.filter(~denied(F.col("path"), ["en/**", "*7*"]))


@query(f"SELECT page_id, url FROM pages WHERE regexp_matches(url, '^.*/en/.*$')")
def scope_filter(spark, d):
    return views.table(spark, d, "pages").filter(context.matches(F.col("url"), "*/en/*")).select("page_id", "url")


_CHUNK = "c AS (SELECT p_type, p_partkey, '## [' || p_type || '] ' || p_name || chr(10) || chr(10) || p_brand || chr(10) AS chunk FROM part)"


def _chunks(spark, d) -> DataFrame:
    rows = views.table(spark, d, "part")
    return rows.select("p_type", "p_partkey", context.chunk_text("p_type", "p_name", "p_brand").alias("chunk"))


@query(f"WITH {_CHUNK} SELECT p_type, p_partkey, used FROM (SELECT *, CAST(sum(length(chunk)) OVER (PARTITION BY p_type ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM c) WHERE used // 4 <= 1500")
def budget_prefix(spark, d):
    return context.within_budget(_chunks(spark, d), ["p_partkey"], 1500, by=["p_type"]).select("p_type", "p_partkey", "used")


@query(f"WITH {_CHUNK} SELECT string_agg(chunk, chr(10) ORDER BY p_type, p_partkey) AS block FROM (SELECT *, sum(length(chunk)) OVER (ORDER BY p_type, p_partkey ROWS UNBOUNDED PRECEDING) AS used FROM c) WHERE used // 4 <= 1500")
def context_block(spark, d):
    order = ["p_type", "p_partkey"]
    return context.block(context.within_budget(_chunks(spark, d), order, 1500), order)


_LOG = """log AS (SELECT doc_id AS candidate_id, 'staged' AS action, NULL AS reason, source AS model FROM documents UNION ALL
SELECT doc_id, CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 0 THEN 'skip' WHEN length(text) > 5000 THEN 'merge' ELSE 'approve' END, CASE WHEN toxic = 1 THEN 'toxic ' || lang END, NULL FROM documents JOIN labels USING (doc_id) UNION ALL
SELECT doc_id, 'gate_drop', 'low quality', NULL FROM labels WHERE quality = 0 AND toxic = 0)"""


@query(f"""WITH {_LOG}, s AS (SELECT count(*) FILTER (action IN ('approve', 'merge', 'reject', 'skip')) AS shown, count(*) FILTER (action IN ('approve', 'merge')) AS approved, count(*) FILTER (action = 'reject') AS rejected, count(*) FILTER (action = 'skip') AS skipped, count(*) FILTER (action IN ('staged', 'gate_drop')) AS extracted, count(*) FILTER (action = 'gate_drop') AS gate_dropped FROM log)
SELECT *, round(approved / shown, 6) AS approval_rate, round(approved / (shown - skipped), 6) AS decided_rate, round(gate_dropped / extracted, 6) AS gate_drop_rate FROM s""")
def review_stats(spark, d):
    return stats.review_stats(views.review_log(spark, d))


@query(f"WITH {_LOG} SELECT coalesce(reason, '(none)') AS label, count(*) AS n FROM log WHERE action IN ('reject', 'gate_drop', 'skip') GROUP BY 1")
def rejection_histogram(spark, d):
    return stats.histogram(views.review_log(spark, d).filter("action in ('reject', 'gate_drop', 'skip')"), "reason", "(none)")


@query("SELECT doc_id AS candidate_id, CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 0 THEN 'skip' WHEN length(text) > 5000 THEN 'merge' ELSE 'approve' END AS action, source AS model FROM documents JOIN labels USING (doc_id)")
def model_attribution(spark, d):
    return stats.model_attribution(views.review_log(spark, d))


@query("""WITH l AS (SELECT user_id, bool_or(event_type = 'purchase') AS queued FROM events WHERE event_type IN ('signup', 'purchase') AND value > 60 GROUP BY user_id), s AS (SELECT DISTINCT user_id FROM events), r AS (SELECT s.user_id, queued FROM s LEFT JOIN l USING (user_id))
SELECT count(*) AS considered, count(*) FILTER (queued) AS captured, count(*) FILTER (queued IS NULL) AS missed, count(*) FILTER (NOT queued) AS failed, round(count(*) FILTER (queued) / count(*), 6) AS capture_rate FROM r""")
def capture_stats(spark, d):
    rows = views.table(spark, d, "events").withColumnRenamed("user_id", "session_id")
    log = rows.filter("event_type in ('signup', 'purchase') and value > 60").select("session_id", (F.col("event_type") == "purchase").alias("enqueued"))
    return stats.capture_stats(rows.select("session_id"), log)


@query("SELECT min(date_trunc('second', ts)) AS window_start FROM events WHERE event_type = 'signup'")
def capture_window(spark, d):
    rows = views.table(spark, d, "events").filter("event_type = 'signup'").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"))
    return stats.capture_start(rows).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"))


def _review(spark, d):
    docs = views.table(spark, d, "documents").join(views.table(spark, d, "labels"), "doc_id", "left")
    rows = docs.select(F.concat(F.lit("fact-"), F.col("doc_id").cast("string")).alias("id"), F.lit("fact").alias("type"), F.col("lang").alias("title"), F.col("source").alias("body"), F.concat(F.lit("old-"), F.col("n_chars").cast("string")).alias("proposed_amendment_of"), F.sha2("text", 256).alias("excerpt_sha256"), "quality", "toxic")
    action = F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "approve").when(F.col("quality") == 0, "skip")
    decisions = rows.select("id", F.coalesce(action, F.lit("skip")).alias("action"), F.when(F.col("toxic") == 1, "toxic").alias("reason"), F.lit(None).cast("string").alias("merge_into"))
    approved = views.table(spark, d, "part").select(F.concat(F.lit("old-"), F.col("p_partkey").cast("string")).alias("id"), F.lit("fact").alias("type"), F.col("p_name").alias("title"), F.col("p_type").alias("body"), F.lit("a").alias("approved_by"), F.lit("2024-01-01").cast("timestamp").alias("updated"))
    return review.decided(rows.drop("quality", "toxic"), decisions, approved), approved


_REV = """r AS (SELECT 'fact-' || doc_id AS id, lang AS title, source AS body, CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'approve' ELSE 'skip' END AS action,
  CASE WHEN toxic = 0 AND quality = 1 AND n_chars IN (SELECT p_partkey FROM part) THEN 'old-' || n_chars END AS target FROM documents LEFT JOIN labels USING (doc_id))"""


@query(f"WITH {_REV} SELECT id, action, target FROM r")
def decisions_applied(spark, d):
    rows, _ = _review(spark, d)
    return rows.select("id", "action", "target")


@query(f"""WITH {_REV}, notes AS (SELECT target AS id, string_agg(chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Amendment (2024-02-03, approved by me)' || chr(10) || chr(10) || body, '' ORDER BY id) || chr(10) AS notes FROM r WHERE target IS NOT NULL GROUP BY target)
SELECT id, title, sha256(body) AS body_sha256 FROM (SELECT 'old-' || p_partkey AS id, p_name AS title, p_type || coalesce(notes, '') AS body FROM part LEFT JOIN notes ON notes.id = 'old-' || p_partkey
UNION ALL SELECT id, title, body FROM r WHERE action = 'approve' AND target IS NULL)""")
def amendments(spark, d):
    rows, approved = _review(spark, d)
    done = review.next_trusted(rows, approved, "me", F.lit("2024-02-03").cast("timestamp"))
    return done.select("id", "title", F.sha2("body", 256).alias("body_sha256"))


_ART = "a AS (SELECT p_brand AS session_id, p_partkey AS ord, p_name AS id, [CASE WHEN p_size % 3 = 0 THEN './src/' || p_type || '/' || p_name ELSE p_type END] AS artifacts, p_size FROM part)"


@query(f"""WITH {_ART}, x AS (SELECT ord, ltrim(unnest(artifacts), './') AS f FROM a) SELECT ord, CASE WHEN contains(f, '/') THEN regexp_replace(f, '/[^/]*$', '') || '/**' ELSE f END AS scope FROM x""")
def derive_scope(spark, d):
    rows = views.table(spark, d, "part")
    paths = F.array(F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("./src/"), "p_type", F.lit("/"), "p_name")).otherwise(F.col("p_type")))
    return rows.select(F.col("p_partkey").alias("ord"), F.array_join(text.derive_scope(paths), ",").alias("scope"))


@query("""WITH t AS (SELECT p_brand AS session_id, list_sort(list_distinct(list(p_type))) AS touched FROM part WHERE p_size <= 20 GROUP BY p_brand),
c AS (SELECT p_brand AS session_id, p_partkey AS ord, p_name AS id, CASE WHEN p_size % 5 = 0 THEN [] ELSE [p_type] END AS artifacts FROM part),
ok AS (SELECT *, row_number() OVER (PARTITION BY session_id, id ORDER BY ord) AS f FROM c JOIN t USING (session_id) WHERE len(list_filter(artifacts, lambda x: NOT list_contains(touched, x))) = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS n FROM ok WHERE f = 1)
SELECT session_id, ord, id, array_to_string(CASE WHEN len(artifacts) = 0 THEN touched ELSE artifacts END, ',') AS artifacts FROM k WHERE n <= 3""")
def artifact_gate(spark, d):
    rows = views.table(spark, d, "part")
    touched = rows.filter("p_size <= 20").groupBy(F.col("p_brand").alias("session_id")).agg(F.array_sort(F.collect_set("p_type")).alias("touched"))
    cand = rows.select(F.col("p_brand").alias("session_id"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("id"), F.when(F.col("p_size") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("p_type")).alias("artifacts"), F.array().cast("array<string>").alias("scope"))
    return extract.gated(cand.join(touched, "session_id")).select("session_id", "ord", "id", F.array_join("artifacts", ",").alias("artifacts"))


@query("""SELECT o.o_orderkey, concat_ws(',', CASE WHEN o.o_orderpriority IS DISTINCT FROM p.o_orderpriority THEN 'priority' END, CASE WHEN o.o_orderstatus IS DISTINCT FROM p.o_orderstatus THEN 'status' END) AS fields FROM orders o LEFT JOIN orders p ON p.o_orderkey = o.o_orderkey + 1""")
def edited_fields(spark, d):
    rows = views.table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    then = rows.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("s").alias("s2"), F.col("p").alias("p2"))
    both = rows.join(then, "o_orderkey", "left")
    names = review.edited_fields({"status": F.col("s"), "priority": F.col("p")}, {"status": F.col("s2"), "priority": F.col("p2")})
    return both.select("o_orderkey", F.array_join(names, ",").alias("fields"))


@query("SELECT count(*) AS checked, count(*) FILTER (length(text) < 100) AS failed, count(*) FILTER (length(text) >= 100 AND lang = 'fr') AS warned FROM documents")
def validate_counts(spark, d):
    return stats.validation_counts(views.table(spark, d, "documents"), F.length("text") >= 100, F.col("lang") == "fr")


@query(r"""SELECT page_id, regexp_replace(url, '[:/\\]', '-', 'g') AS slug, CAST(regexp_extract(url, '([0-9]+)', 1) AS VARCHAR) AS version FROM pages""")
def slug_and_version(spark, d):
    return views.table(spark, d, "pages").select("page_id", text.project_slug(F.col("url")).alias("slug"), F.coalesce(F.array_join(F.slice(text.version(F.col("url")).cast("array<string>"), 1, 1), "."), F.lit("")).alias("version"))


@query("SELECT doc_id, CAST(title AS VARCHAR) AS title FROM (SELECT doc_id, source AS title FROM documents)")
def response_parse(spark, d):
    """Model responses, half of them in a code fence, parsed back."""
    rows = views.table(spark, d, "documents").select("doc_id", F.to_json(F.struct(F.array(F.struct(F.col("source").alias("title"))).alias("candidates"))).alias("r"))
    from sessionloom.sources.readers import response_candidates

    fenced = rows.withColumn("r", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```json\n"), "r", F.lit("\n```"))).otherwise(F.col("r")))
    return response_candidates(fenced, "r").select("doc_id", F.explode("candidates").alias("c")).select("doc_id", "c.title")


@query("SELECT coalesce(nullif(trim(event_type), ''), 'unrecorded') AS label, count(*) AS n FROM events GROUP BY 1")
def capture_modes(spark, d):
    return stats.histogram(views.table(spark, d, "events"), "event_type", "unrecorded")


@query()
def redact_documents(spark, d):
    """All documents, redacted by all patterns and the entropy check."""
    rows = views.table(spark, d, "documents")
    return rows.select("doc_id", redaction.redactor()(F.col("text")).alias("text"))


@query()
def queue_sweep_stream(spark, d):
    """The events as queue jobs, drained by a stream; jobs without a path go to the dead letters."""
    from sessionloom.streaming.sweep import drain_table

    jobs = views.table(spark, d, "events").select(F.col("event_id").cast("string").alias("session_id"), F.when(F.col("event_type") != "signup", F.concat(F.lit("/t/"), F.col("event_id").cast("string"))).alias("transcript_path"), F.lit("jsonl").alias("harness"), F.col("ts").cast("string").alias("enqueued_at"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("commit"))
    return drain_table(spark, jobs)


@query()
def model_extract_stub(spark, d):
    """Conversations' excerpts through the model extractor with a fixed client."""
    turns = views.talk_turns(spark, d)
    spans = salience.merge_spans(salience.phrase_spans(turns, _RETRY, _REVERSAL))
    rows = salience.excerpts(spans, turns, salience.render_turn()).withColumn("known", F.array().cast("array<string>")).withColumn("touched", F.array(F.lit("a.py")))
    from sessionloom.sources.readers import response_candidates

    asked = extract.model_responses(rows.withColumn("prompt", extract.prompt()), lambda p: '{"candidates":[{"id":"x","type":"fact","title":"%d","artifacts":[],"scope":[],"tags":[],"confidence":"low","body":"b"}]}' % len(p))
    got = response_candidates(asked, "response").select("session_id", F.posexplode("candidates").alias("ord", "c")).select("session_id", "ord", "c.title", "c.id", "c.artifacts", "c.scope", F.array(F.lit("a.py")).alias("touched"))
    return extract.gated(got).select("session_id", "ord", "title", F.array_join("scope", ",").alias("scope"))


@query()
def judge_stub(spark, d):
    """Rule candidates judged by a fixed judge."""
    rows = extract.rule_candidates(_errors(spark, d), extract.touched_files(_diffs(spark, d)))
    return extract.judged(rows.select("id", "body"), lambda p: {"actionable": "click" in p, "project_specific": True, "stable": False, "future_useful": True} | {f"{n}_reason": "fixed" for n in extract.CRITERIA})


@query("""SELECT p_partkey FROM part WHERE p_size % 3 <> 0 AND (starts_with(p_brand, 'Brand#1') OR p_size % 5 = 0)""")
def entries_in_scope(spark, d):
    """Parts whose scope patterns match a path; some have none, some a set of characters, some an unclosed one."""
    brand = F.concat(F.substring("p_brand", 1, 7), F.lit("*"))
    scope = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).when(F.col("p_size") % 5 == 0, F.array(F.lit("x"), F.lit("[!a-z]rand#[0-3]?/*"))).otherwise(F.array(brand, F.lit("Brand[")))
    return context.in_scope(views.table(spark, d, "part").withColumn("scope", scope), "Brand#13/a").select("p_partkey")


@query("""SELECT doc_id, concat_ws('; ', CASE WHEN doc_id % 5 = 0 THEN 'more: unknown field' END, CASE WHEN doc_id % 2 = 0 THEN 'id: missing' END, 'type: not one of strategy, gotcha, fact',
  CASE WHEN doc_id % 3 = 0 THEN 'tags.0: not of kind str' END, CASE WHEN doc_id % 7 <> 0 THEN 'confidence: not one of low, medium, high' END) AS errors FROM documents""")
def candidate_errors(spark, d):
    """Candidates with wrong fields, and what is wrong with each."""
    from sessionloom.sources.store import checked_candidates

    when = lambda q, c: F.when(F.expr(q), c)
    raw = F.to_json(F.struct(when("doc_id % 5 = 0", F.lit(1)).alias("more"), when("doc_id % 2 = 1", F.col("source")).alias("id"), F.col("lang").alias("type"), F.col("source").alias("title"), when("doc_id % 3 = 0", F.array(F.lit(3))).alias("tags"), F.when(F.expr("doc_id % 7 = 0"), "low").otherwise("some").alias("confidence"), F.lit("b").alias("body")))
    rows = checked_candidates(views.table(spark, d, "documents").select("doc_id", raw.alias("raw")))
    return rows.select("doc_id", F.array_join("errors", "; ").alias("errors"))


@query(f"WITH {_REV} SELECT count(*) FILTER (action = 'approve') AS approved, count(*) FILTER (action = 'reject') AS rejected, count(*) FILTER (action = 'skip') AS skipped, count(*) FILTER (action = 'skip') AS remaining FROM r")
def review_summary(spark, d):
    return review.summary(_review(spark, d)[0])


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'merged into old-' || doc_id % 50 + 1 END AS reason, CASE WHEN doc_id % 4 = 1 THEN 'title,body' ELSE '' END AS edited, CASE WHEN doc_id % 4 = 1 THEN 'new ' || lang ELSE lang END AS title
FROM documents WHERE doc_id % 4 <= 1""")
def merges_and_edits(spark, d):
    """Documents as staged entries, a quarter of them merged into parts, a quarter edited and approved."""
    docs = views.table(spark, d, "documents")
    staged = docs.select(F.col("doc_id").cast("string").alias("id"), F.lit("fact").alias("type"), F.col("lang").alias("title"), F.col("source").alias("body"), F.lit(None).cast("string").alias("proposed_amendment_of"))
    action = F.when(F.col("doc_id") % 4 == 0, "merge").otherwise("approve_with_edit")
    edit = F.struct(F.concat(F.lit("new "), "lang").alias("title"), F.concat("source", F.lit(" more")).alias("body"))
    decisions = docs.filter("doc_id % 4 <= 1").select(F.col("doc_id").cast("string").alias("id"), action.alias("action"), F.lit(None).cast("string").alias("reason"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("old-"), (F.col("doc_id") % 50 + 1).cast("string"))).alias("merge_into"), F.when(F.col("doc_id") % 4 == 1, edit).alias("edited"))
    approved = views.table(spark, d, "part").select(F.concat(F.lit("old-"), F.col("p_partkey").cast("string")).alias("id"), F.lit("fact").alias("type"))
    log = review.log_rows(review.decided(staged, decisions, approved).filter("action != 'skip'"), F.lit("2024-02-03").cast("timestamp"))
    return log.select(F.col("candidate_id").cast("long").alias("doc_id"), "reason", F.array_join("edited_fields", ",").alias("edited"), "title")


@query(f"""WITH {_CUR} SELECT c.id AS candidate_id, CASE WHEN d.id IS NULL THEN 'staged' ELSE 'gate_drop' END AS action, CASE WHEN d.id IS NOT NULL THEN 'tombstone' END AS reason FROM cand c LEFT JOIN dead d USING (id)""")
def staging_log(spark, d):
    cand, approved, staged, stones = _curation(spark, d)
    entries = cand.withColumn("evidence", F.struct(F.lit("s").alias("session_id"), F.lit("h").alias("harness")))
    _, log = curate.staged_entries(entries, curate.outcomes(cand, approved, staged, stones), "rules", F.lit("2024-02-03").cast("timestamp"))
    return log.select("candidate_id", "action", "reason")


@query(f"""WITH RECURSIVE {_FIX} SELECT x.fixture, x.pos, m.cand IS NOT NULL AS matched,
  EXISTS (SELECT 1 FROM (SELECT x.title AS a, y.title AS b FROM f y WHERE y.fixture = x.fixture AND y.size <= 25 AND y.pos < x.pos) WHERE {_OVER} >= 0.6) AS duplicate, x.pos % 2 = 0 AS atomic FROM f x LEFT JOIN m ON m.fixture = x.fixture AND m.cand = x.pos WHERE x.size <= 25""")
def fixture_records(spark, d):
    """Parts as fixtures' candidates, each with its scoring record."""
    cand, gold = _fixtures(spark, d)
    body = F.when(F.col("pos") % 2 == 0, "## One\n\ntext").otherwise("```\n## none\n```")
    cand = cand.select("fixture", "pos", F.col("pos").cast("string").alias("id"), F.lit("fact").alias("type"), "title", body.alias("body"), F.lit(True).alias("valid"), F.lit("s").alias("session_id"), F.array(F.lit("a")).alias("artifacts"), F.lit("").alias("excerpt_sha256"), *(F.lit(True).alias(c) for c in extract.CRITERIA), F.lit(None).cast("string").alias("judge_error"))
    return evaluate.fixture_records(cand, gold).select("fixture", "pos", "matched", "duplicate", "atomic")


def _event_trace(spark, d) -> trace.Trace:
    """Each user's events as a trace: errors and purchases are tool results, some without output; the rest are changes."""
    turns = views.event_turns(spark, d)
    sessions = normalize.bounds(turns.withColumnRenamed("session_id", "session"), F.current_timestamp()).select(F.col("session").alias("session_id"), F.lit("h").alias("harness"), "started_at", "ended_at", F.lit("c0").alias("commit"))
    output = F.when(F.col("k") % 2 == 0, F.concat(F.lit("bad click.py "), F.col("test").cast("string")))
    results = turns.filter("event_type in ('error', 'purchase')").select("session_id", "idx", F.lit(0).alias("pos"), F.col("event_type").alias("name"), "is_error", output.alias("output"))
    return trace.Trace(sessions, turns.select("session_id", "idx", "role", "content"), results, turns.select("session_id", F.lit(0).cast("long").alias("ord"), F.lit("").alias("error")).limit(0), _diffs(spark, d).withColumn("patch", F.lit("")))


@query(f"""WITH {_B}, e AS (SELECT session_id, CASE WHEN k % 2 = 0 THEN 'bad click.py ' || k % 10 ELSE 'error failed' END AS error, min(idx) AS ord FROM b WHERE is_error GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS n FROM e), c AS (SELECT DISTINCT session_id FROM b WHERE event_type = 'click'), m AS (SELECT session_id, max(ts) AS ended FROM b GROUP BY session_id)
SELECT n.session_id, 'gotcha-' || substr(sha256(n.session_id || ':' || error), 1, 6) AS id, error AS title, CASE WHEN c.session_id IS NOT NULL AND contains(error, 'click.py') THEN 'click.py' ELSE '' END AS artifacts, strftime(ended, '%Y-%m-%dT%H:%M:%S.%fZ') AS captured_at, 'c0' AS "commit"
FROM n JOIN m USING (session_id) LEFT JOIN c ON c.session_id = n.session_id WHERE n <= 3""")
def rule_entries(spark, d):
    """The rule extractor over whole traces, with the evidence of its entries."""
    t = _event_trace(spark, d)
    rows = extract.rule_entries(trace.replace(t, diffs=extract.touched_files(t.diffs)))
    return rows.select("session_id", "id", "title", F.array_join("evidence.artifacts", ",").alias("artifacts"), "evidence.captured_at", "evidence.commit")


@query(f"""SELECT page_id, {_PATH} AS file, '+ [REDACTED:assignment]' AS patch FROM pages WHERE NOT regexp_matches({_PATH}, '^en/.*$')""")
def trace_redaction(spark, d):
    """Pages as changed files with a secret in each patch: denied ones go, the others are redacted."""
    pages = views.table(spark, d, "pages").select(F.col("page_id").alias("session_id"), F.lit(0).alias("idx"), F.regexp_replace("url", "^[a-z]+://[^/]*/?", "").alias("file"), F.concat(F.lit("+ password="), F.substring(F.sha2("url", 256), 1, 20)).alias("patch"))
    none = pages.select("session_id", "idx", F.lit("").alias("role"), F.lit("").alias("content")).limit(0)
    results = none.select("session_id", "idx", F.lit(0).alias("pos"), F.lit("").alias("name"), F.lit(False).alias("is_error"), F.lit("").alias("output"))
    t = trace.Trace(pages.select("session_id"), none, results, none.select("session_id", F.lit(0).alias("ord"), F.lit("").alias("error")), pages.select("session_id", F.col("idx").alias("ord"), "file", "patch"))
    return trace.redacted(t, ["en/**"]).diffs.select(F.col("session_id").alias("page_id"), "file", "patch")


@query(f"""WITH {_B} SELECT session_id, idx, '[' || idx || '] tool: ' || event_type || CASE WHEN event_type IN ('error', 'purchase') THEN chr(10) || '    tool_result(' || event_type || CASE WHEN is_error THEN ', error): ' ELSE ', ok): ' END || CASE WHEN k % 2 = 0 THEN 'bad click.py ' || k % 10 ELSE 'None' END ELSE '' END AS line FROM b""")
def rendered_turns(spark, d):
    """Turns as an excerpt shows them, with their tool results."""
    return _event_trace(spark, d).turn_rows().select("session_id", "idx", salience.render_turn("results").alias("line"))


def _decisions(spark, d):
    """Staged documents, of which those without a label are left undecided, as by a review that ended early."""
    docs = views.table(spark, d, "documents").join(views.table(spark, d, "labels"), "doc_id", "left")
    rows = docs.select(F.concat(F.lit("fact-"), F.col("doc_id").cast("string")).alias("id"), F.lit("fact").alias("type"), F.col("lang").alias("title"), F.col("source").alias("body"), F.concat(F.lit("old-"), F.col("n_chars").cast("string")).alias("proposed_amendment_of"), F.sha2("text", 256).alias("excerpt_sha256"), "quality", "toxic")
    action = F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "approve").when(F.col("quality") == 0, "skip")
    decisions = rows.filter("quality is not null").select("id", action.alias("action"), F.when(F.col("toxic") == 1, "\ttoxic ").alias("reason"), F.lit(None).cast("string").alias("merge_into"))
    approved = views.table(spark, d, "part").select(F.concat(F.lit("old-"), F.col("p_partkey").cast("string")).alias("id"), F.lit("fact").alias("type"), F.col("p_name").alias("title"), F.col("p_type").alias("body"), F.lit("a").alias("approved_by"), F.lit("2024-01-01").cast("timestamp").alias("updated"))
    return rows.drop("quality", "toxic"), decisions, approved


_LEFT = """r AS (SELECT 'fact-' || doc_id AS id, lang AS title, source AS body, sha256(text) AS hash, CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'approve' WHEN quality = 0 THEN 'skip' END AS action,
  CASE WHEN toxic = 0 AND quality = 1 AND n_chars IN (SELECT p_partkey FROM part) THEN 'old-' || n_chars END AS target FROM documents LEFT JOIN labels USING (doc_id))"""


@query(f"""WITH {_LEFT} SELECT count(*) FILTER (action = 'approve') AS approved, count(*) FILTER (action = 'reject') AS rejected, count(*) FILTER (action = 'skip') AS skipped, count(*) FILTER (action = 'skip' OR action IS NULL) AS remaining,
  count(action) AS logged FROM r""")
def review_left_early(spark, d):
    """A review that ended before all entries were decided: what it counts, and how many rows it logs."""
    rows = review.decided(*_decisions(spark, d))
    logged = review.log_rows(rows, F.lit("2024-02-03").cast("timestamp")).agg(F.count(F.lit(1)).alias("logged"))
    return review.summary(rows).join(logged)


@query(f"""WITH {_LEFT} SELECT id, title, 'toxic' AS reason, hash AS excerpt_sha256 FROM r WHERE action = 'reject'""")
def tombstones_of_review(spark, d):
    return review.next_tombstones(review.decided(*_decisions(spark, d)))


@query(f"""WITH {_LEFT}, all_rows AS (
SELECT 1 AS version, 'approved' AS place, 'old-' || p_partkey AS id FROM part UNION ALL SELECT 1, 'staged', id FROM r
UNION ALL SELECT 2, 'approved', 'old-' || p_partkey FROM part UNION ALL SELECT 2, 'approved', id FROM r WHERE action = 'approve' AND target IS NULL
UNION ALL SELECT 2, 'staged', id FROM r WHERE action = 'skip' OR action IS NULL UNION ALL SELECT 2, 'tombstones', id FROM r WHERE action = 'reject')
SELECT * FROM all_rows""")
def store_versions(spark, d):
    """A store before and after one review: both versions stay readable."""
    from sessionloom.sources import shared, versions

    staged, decisions, approved = _decisions(spark, d)
    root = shared.shared_folder(spark, "store")
    versions.start(spark, root, {"approved": approved, "staged": staged})
    versions.decide(spark, root, decisions, "me", F.lit("2024-02-03").cast("timestamp"))
    return versions.history(spark, root)


@query(f"WITH RECURSIVE {_FIX} SELECT * FROM m")
def gold_matches_by_rounds(spark, d):
    """The assignment of every fixture, however large, by rounds of mutually best pairs."""
    cand, gold = _fixtures(spark, d)
    return evaluate.gold_matches(cand, gold, fold_pairs=0).withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE v AS (SELECT p_brand AS suite, p_size AS fixture, p_partkey AS ord, p_name AS title, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS rn FROM part),
near AS (SELECT suite, rn, list(other) AS before FROM (SELECT x.suite, x.rn, y.rn AS other, x.title AS a, y.title AS b FROM v x JOIN v y ON x.suite = y.suite AND y.fixture < x.fixture) WHERE {_OVER} >= 0.6 GROUP BY ALL),
mates AS (SELECT x.suite, x.rn, list(y.rn) AS mates FROM v x JOIN v y ON x.suite = y.suite AND y.fixture = x.fixture AND y.rn < x.rn GROUP BY ALL),
w AS (SELECT v.*, coalesce(before, []) AS before, coalesce(mates, []) AS mates FROM v LEFT JOIN near USING (suite, rn) LEFT JOIN mates USING (suite, rn)),
walk AS (SELECT suite, 0::BIGINT AS rn, []::BIGINT[] AS done, false AS took FROM (SELECT DISTINCT suite FROM v)
  UNION ALL SELECT w.suite, w.rn, CASE WHEN ok THEN list_append(done, w.rn) ELSE done END, ok FROM (SELECT w.*, done, len(list_intersect(before, done)) = 0 AND len(list_intersect(mates, done)) < 3 AS ok FROM walk JOIN w ON w.suite = walk.suite AND w.rn = walk.rn + 1) w)
SELECT v.suite, v.fixture, v.ord, v.title FROM walk JOIN v USING (suite, rn) WHERE took""")
def suite_emission(spark, d):
    """Parts as a suite's candidates: what each fixture emits when it knows what those before it emitted, three at most."""
    rows = views.table(spark, d, "part").select(F.col("p_brand").alias("suite"), F.col("p_size").alias("fixture"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("title"))
    return evaluate.emitted(rows, 3)


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS line FROM events WHERE event_type <> 'click' AND event_id % 7 <> 0")
def log_lines(spark, d):
    """Events as logs of one type each, with blank and broken lines between, read back in order by as many tasks as there are splits."""
    from sessionloom.sources import readers, shared

    rows = views.table(spark, d, "events").filter("event_type != 'click'")
    line = F.when(F.col("event_id") % 7 == 0, F.when(F.col("event_id") % 2 == 0, "").otherwise("{broken")).otherwise(F.to_json(F.struct(F.col("event_id").cast("string").alias("session_id"), F.col("event_type").alias("reason"))))
    root = shared.shared_folder(spark, "logs")
    rows.select("event_type", "event_id", line.alias("value")).repartition("event_type").sortWithinPartitions("event_type", "event_id").drop("event_id").write.partitionBy("event_type").text(root)
    log = readers.json_lines(spark, root, readers.CAPTURE_LOG, strict=True)
    return log.select(F.col("session_id").cast("long").alias("event_id"), F.row_number().over(Window.partitionBy("file").orderBy("ord")).cast("long").alias("line"))


def _jobs(rows: DataFrame) -> DataFrame:
    path = F.concat(F.lit("/t/"), F.col("event_id").cast("string"))
    return rows.select(F.col("user_id").cast("string").alias("session_id"), path.alias("transcript_path"), F.lit("jsonl").alias("harness"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("enqueued_at"))


@query("""WITH e AS (SELECT *, event_id % 3 AS part FROM events WHERE value > 40), best AS (SELECT user_id, part, max(ts) AS ts, arg_max(event_id, ts) AS event_id FROM e GROUP BY ALL),
up AS (SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM best)
SELECT CAST(part AS INTEGER) AS sweep, CAST(user_id AS VARCHAR) AS session_id, '/t/' || event_id AS transcript_path FROM up WHERE known IS NULL OR ts >= known""")
def sweep_latest_jobs(spark, d):
    """Events as jobs of their users, in three sweeps: a job that is older than one that was handled is left out."""
    from sessionloom.streaming.sweep import drained_sessions

    rows = views.table(spark, d, "events").filter("value > 40")
    return drained_sessions(spark, [_jobs(rows.filter(F.col("event_id") % 3 == k)) for k in range(3)])


@query("SELECT CAST(conv_id AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, role, sha256(text) AS content_sha256 FROM conversations WHERE role <> 'system'")
def job_transcripts(spark, d):
    """Conversations as transcript files, which jobs name by path and the executors read."""
    from sessionloom.sources import readers, shared

    rows = views.table(spark, d, "conversations")
    message = F.struct(F.col("role").alias("type"), F.col("conv_id").cast("string").alias("sessionId"), F.struct("role", F.col("text").alias("content")).alias("message"))
    root = shared.shared_folder(spark, "transcripts")
    rows.select(F.col("conv_id").alias("conv"), "turn", F.to_json(message).alias("value")).repartition("conv").sortWithinPartitions("conv", "turn").drop("turn").write.partitionBy("conv").text(root)
    jobs = spark.read.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("transcript_path")).withColumn("session_id", F.lit("job"))
    t = trace.of_jsonl(normalize.jsonl_records(readers.job_texts(jobs).filter("why is null")), "jsonl")
    return t.turns.select("session_id", F.col("idx").cast("long").alias("idx"), "role", F.sha2("content", 256).alias("content_sha256"))


def _replaced(text: str) -> str:
    """All named patterns replaced one after the other, those that may hold another's match first; as the patterns' matches
    in these tables do not overlap otherwise, that is the choice by start."""
    for name, pattern in sorted(redaction.PATTERNS, key=lambda p: p[0] not in ("aws-secret", "assignment", "bearer", "url-credentials")):
        quoted = pattern.replace("'", "''")
        text = f"regexp_replace({text}, '{quoted}', '[REDACTED:{name}]', 'g')"
    return text


@query(f"SELECT doc_id, sha256({_replaced('text')}) AS redacted_sha256 FROM documents")
def redact_all_patterns(spark, d):
    """Every document with the matches of all named patterns redacted, without the entropy check."""
    clean = redaction.redactor(least_entropy=float("inf"))
    return views.table(spark, d, "documents").select("doc_id", F.sha2(clean(F.col("text")), 256).alias("redacted_sha256"))


def _record_lines(spark, d) -> DataFrame:
    """Events as the lines of their users' transcripts: clicks use a tool, purchases and errors are its results, some with
    text; views are users' words, signups no message; a line in eleven is broken."""
    e = views.event_turns(spark, d)
    block = lambda **c: F.array(F.struct(*(x.alias(n) for n, x in c.items())))
    ident = F.col("test").cast("string")
    use = F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(block(type=F.lit("tool_use"), id=ident, name=F.concat(F.lit("tool "), F.col("event_id").cast("string"))).alias("content")).alias("message")))
    result = F.to_json(F.struct(F.lit("user").alias("type"), F.struct(block(type=F.lit("tool_result"), tool_use_id=ident, is_error=F.col("is_error"), content=F.concat(F.lit("out "), ident)).alias("content")).alias("message")))
    said = F.to_json(F.struct(F.lit("user").alias("type"), F.struct(F.lit("hello").alias("content")).alias("message")))
    line = F.when(F.col("event_id") % 11 == 0, "{").when(F.col("event_type") == "click", use).when(F.col("event_type").isin("purchase", "error"), result).when(F.col("event_type") == "view", said).otherwise('{"type": "summary"}')
    return e.select(F.concat(F.lit("/t/u"), F.col("session_id").cast("string"), F.lit(".jsonl")).alias("file"), F.col("idx").alias("ord"), line.alias("line"))


_TURNS = f"""{_B}, kinds AS (SELECT session_id, idx, k % 10 AS test, event_id, is_error, CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'U' ELSE 'R' END AS kind FROM b WHERE event_type <> 'signup' AND event_id % 11 <> 0),
prior AS (SELECT *, last_value(CASE WHEN kind <> 'R' THEN kind END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM kinds),
joined AS (SELECT *, kind = 'R' AND coalesce(prior = 'A', false) AS joins FROM prior),
t AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY idx) - 1 AS turn FROM joined)"""


@query(f"WITH {_TURNS} SELECT 'u' || session_id AS session, CAST(turn AS BIGINT) AS idx, CASE WHEN kind = 'A' THEN 'assistant' ELSE 'user' END AS role, CASE WHEN kind = 'U' THEN 'hello' ELSE '' END AS content FROM t WHERE NOT joins")
def turn_assignment(spark, d):
    """Transcript lines as turns: results join the assistant's turn before them, or start a user's."""
    rows = normalize.assigned_turns(normalize.jsonl_records(_record_lines(spark, d)))
    return rows.filter("not joins").select("session", F.col("idx").cast("long").alias("idx"), "role", "content")


@query(f"""WITH {_TURNS}, used AS (SELECT r.session_id, r.idx, max(u.idx) AS at FROM t r LEFT JOIN t u ON u.session_id = r.session_id AND u.kind = 'A' AND u.test = r.test AND u.idx < r.idx WHERE r.joins GROUP BY ALL)
SELECT 'u' || t.session_id AS session, CAST(turn AS BIGINT) AS idx, t.idx AS ord, coalesce('tool ' || n.event_id, 'tool') AS name, t.is_error, 'out ' || t.test AS output
FROM t JOIN used USING (session_id, idx) LEFT JOIN b n ON n.session_id = t.session_id AND n.idx = used.at""")
def attached_results(spark, d):
    """Tool results with the turn that they join and the name of the latest call of their id."""
    rows = normalize.tool_results(normalize.assigned_turns(normalize.jsonl_records(_record_lines(spark, d))))
    return rows.select("session", F.col("idx").cast("long").alias("idx"), "ord", "name", "is_error", "output")


@query(f"""WITH {_B}, e AS (SELECT session_id, CASE WHEN k % 2 = 0 THEN 'bad click.py ' || k % 10 ELSE 'error failed' END AS error, min(idx) AS ord FROM b WHERE is_error GROUP BY ALL),
known AS (SELECT * FROM (VALUES ('bad click.py 3'), ('quite another lesson')) AS t(b)), n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ord) AS n FROM (SELECT e.*, error AS a FROM e) e WHERE NOT EXISTS (SELECT 1 FROM known WHERE {_OVER} >= 0.6))
SELECT session_id, error AS title FROM n WHERE n <= 3""")
def unknown_lessons(spark, d):
    """The rule extractor leaves out what overlaps a known title."""
    t = _event_trace(spark, d)
    known = spark.createDataFrame([("bad click.py 3",), ("quite another lesson",)], "title string")
    return extract.rule_entries(trace.replace(t, diffs=extract.touched_files(t.diffs)), known).select("session_id", "title")


def _fixed_answer(prompt: str) -> str:
    """What the fixed client says: four lessons, of which one has an unknown field, one cites a file that was not changed, and
    one repeats a title; nothing for prompts without an excerpt line of an error."""
    lesson = {"id": "x", "type": "fact", "title": "First lesson", "confidence": "low", "body": "b"}
    made = [lesson, lesson | {"odd": 1}, lesson | {"title": "Second lesson", "artifacts": ["none.py"]}, lesson | {"title": "Third lesson", "artifacts": ["click.py"], "scope": ["click.py", "other"]}, lesson]
    return "```json\n" + json.dumps({"candidates": made}) + "\n```" if "error): " in prompt else "no"


@query(f"""WITH {_B}, s AS (SELECT session_id FROM b GROUP BY session_id HAVING count(*) >= 4 AND bool_or(is_error)),
touched AS (SELECT session_id, string_agg(file, ',' ORDER BY p0) AS files, list(file) AS every FROM (SELECT session_id, event_type || '.py' AS file, min(idx) AS p0 FROM b WHERE NOT is_error GROUP BY ALL) GROUP BY session_id),
c AS (SELECT s.session_id, 'First lesson' AS title, coalesce(files, '') AS artifacts, coalesce(array_to_string(list_sort(every), ','), '') AS scope FROM s LEFT JOIN touched USING (session_id) UNION ALL SELECT session_id, 'Third lesson', 'click.py', 'click.py' FROM s JOIN touched USING (session_id) WHERE list_contains(every, 'click.py'))
SELECT session_id, 'fact-' || substr(sha256(session_id || ':' || title), 1, 6) AS id, title, artifacts, scope FROM c""")
def model_entries(spark, d):
    """The model extractor over whole traces, with a client that gives fixed answers."""
    t = _event_trace(spark, d)
    known = spark.createDataFrame([("fact-1", "fact", "Known")], "id string, type string, title string")
    rows = extract.model_entries(trace.replace(t, diffs=extract.touched_files(t.diffs).withColumn("patch", F.lit(""))), known, _fixed_answer)
    return rows.select("session_id", "id", "title", F.array_join("evidence.artifacts", ",").alias("artifacts"), F.array_join("scope", ",").alias("scope"))


@query("""SELECT count(*) AS checked, count(*) FILTER (doc_id % 5 = 0 OR lang = 'fr' OR n_chars < 100) AS failed, count(*) FILTER (NOT (doc_id % 5 = 0 OR lang = 'fr' OR n_chars < 100) AND doc_id % 2 = 0) AS warned FROM documents""")
def validated_entries(spark, d):
    """Documents as entries, a fifth of them with an unknown field, the French ones of no type, the short ones without a time."""
    docs = views.table(spark, d, "documents")
    at = F.lit("2024-01-02T03:04:05Z")
    entry = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.when(F.col("lang") == "fr", "lore").otherwise("fact").alias("type"), F.col("source").alias("title"), F.lit("staged").alias("status"), F.lit("1").alias("spec_version"), F.when(F.col("doc_id") % 2 == 1, F.array("lang")).otherwise(F.array()).alias("scope"), F.lit("low").alias("confidence"), F.struct(F.lit("h").alias("harness"), at.alias("captured_at")).alias("evidence"), at.alias("created"), F.when(F.col("n_chars") >= 100, at).otherwise("soon").alias("updated"), F.when(F.col("doc_id") % 5 == 0, 1).alias("odd")))
    rows = docs.select(F.size(schema.problem_list(entry, schema.ENTRY)).alias("n"), (F.col("doc_id") % 2 == 0).alias("no_scope"))
    return stats.validation_counts(rows, F.col("n") == 0, F.col("no_scope"))


@query("""SELECT place, id, CAST(row_number() OVER (PARTITION BY place ORDER BY type_ord, file_name) AS BIGINT) AS at FROM (
SELECT CASE WHEN p_size <= 10 THEN 'staged' WHEN p_size <= 20 THEN 'rejected' WHEN p_size <= 40 THEN 'approved' ELSE 'archived' END AS place, printf('part-%06d', p_partkey) AS id, CASE WHEN p_size <= 20 THEN 0 ELSE length(p_type) END AS type_ord, p_name || p_partkey AS file_name FROM part) WHERE place <> 'archived'""")
def routed_listing(spark, d):
    """Parts as entries of four places; those of a status come from their place, in the order in which a store lists them."""
    from sessionloom.sources.readers import routed_entries

    parts = views.part_entries(spark, d).withColumn("file_name", F.concat("title", F.col("seq").cast("string"))).withColumn("type_ord", F.length("type"))
    typed = parts.filter("size > 20").withColumn("status", F.when(F.col("size") <= 40, "approved").otherwise("archived"))
    out = None
    for status in ("staged", "rejected", "approved"):
        rows = routed_entries(parts.filter("size <= 10"), typed, parts.filter("size between 11 and 20"), status).withColumn("n", F.monotonically_increasing_id())
        rows = rows.select(F.lit(status).alias("place"), "id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("n")).cast("long").alias("at"))
        out = rows if out is None else out.unionByName(rows)
    return out
