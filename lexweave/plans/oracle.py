"""DuckDB twins of the queries."""

from .views import CAP, SAMPLE, SEED

LIMITS = "CASE type WHEN 'Fandom' THEN 3 WHEN 'Character' THEN 3 WHEN 'Relationship' THEN 2 WHEN 'Freeform' THEN 4 ELSE 1 END"


def h(seed: str, key: str) -> str:
    return f"sha256('{seed}:' || {key})"


def bits(key: str) -> str:
    return f"CAST(CAST('0x' || substr({h(SEED, key)}, 1, 16) AS UBIGINT) % 10 AS INTEGER)"


def split(key: str) -> str:
    return f"CASE WHEN {bits(key)} < 6 THEN 'development' WHEN {bits(key)} < 8 THEN 'calibration' ELSE 'test' END"


GOOD = "NOT canonical AND visible AND merger_id IS NOT NULL AND status = 'RESOLVED' AND target_visible AND type = target_type"

CTE = f"""
WITH RECURSIVE pg AS (SELECT *, p_partkey // 10 AS g, p_partkey % 10 AS pos, p_partkey + 1 AS i FROM part),
pb AS (SELECT g, p_name || ' ' || p_brand || ' ' || g AS base FROM pg WHERE pos = 0),
tag AS (SELECT CAST(i AS BIGINT) AS id, CASE WHEN g % 2 = 0 THEN 'Freeform' WHEN g % 4 = 1 THEN 'Character' ELSE 'Fandom' END AS type,
    CASE pos WHEN 0 THEN base WHEN 1 THEN upper(base) WHEN 2 THEN replace(base, ' ', '-') WHEN 3 THEN 'my ' || base WHEN 4 THEN base || 's' WHEN 5 THEN p_name
      WHEN 6 THEN p_name || ' ' || p_brand || ' ' || i WHEN 7 THEN 'Redacted' ELSE lower(base) || '!' END AS name,
    pos IN (0, 6) OR (pos = 8 AND g % 5 = 0) AS canonical, CAST(p_size AS BIGINT) AS cached_count,
    CAST(CASE WHEN pos IN (1, 2, 3, 7) THEN i - pos WHEN pos = 4 THEN i - 1
      WHEN pos = 8 THEN CASE g % 5 WHEN 0 THEN i - 8 WHEN 1 THEN i + 10000000 WHEN 2 THEN i + 1 WHEN 3 THEN i + 2 ELSE i END
      WHEN pos = 9 THEN CASE WHEN g % 5 IN (0, 2) THEN i - 1 ELSE i - 9 END END AS BIGINT) AS merger_id
  FROM pg JOIN pb USING (g)),
walk AS (SELECT id, id AS cur, 0 AS h FROM tag UNION ALL
  SELECT w.id, t.merger_id, h + 1 FROM walk w JOIN tag t ON t.id = w.cur WHERE t.merger_id IS NOT NULL AND NOT t.canonical AND h < 30),
last AS (SELECT id, max(h) AS h, arg_max(cur, h) AS cur FROM walk GROUP BY id),
resolved AS (SELECT l.id, CASE WHEN h < 30 AND t.canonical AND t.merger_id IS NULL THEN t.id END AS terminal,
    CASE WHEN h >= 30 THEN 'CYCLE' WHEN t.id IS NULL THEN 'MISSING' WHEN t.canonical AND t.merger_id IS NOT NULL THEN 'CONFLICT' WHEN t.canonical THEN 'RESOLVED' ELSE 'UNMERGED' END AS status,
    CAST(CASE WHEN h >= 30 THEN 0 ELSE h END AS BIGINT) AS hops FROM last l LEFT JOIN tag t ON t.id = l.cur),
full_ AS (SELECT t.*, r.terminal, r.status, r.hops, trim(t.name) <> '' AND t.name <> 'Redacted' AS visible, e.name AS target_name, e.type AS target_type,
    coalesce(trim(e.name) <> '' AND e.name <> 'Redacted', false) AS target_visible FROM tag t JOIN resolved r USING (id) LEFT JOIN tag e ON e.id = r.terminal),
catalogue AS (SELECT * FROM full_ WHERE canonical AND visible AND merger_id IS NULL),
syn AS (SELECT id, type, name, cached_count, terminal AS canonical_id, target_name AS canonical_name, hops FROM full_ WHERE {GOOD}),
ff AS (SELECT * FROM catalogue WHERE type = 'Freeform'), al AS (SELECT * FROM syn WHERE type = 'Freeform'),
q AS (SELECT id AS query_id, name AS query_name, canonical_id, cached_count, canonical_name FROM
   (SELECT *, {h(SEED, "id")} AS hh, row_number() OVER (PARTITION BY canonical_id ORDER BY {h(SEED, "id")}, id) AS n FROM al) WHERE n <= {CAP} ORDER BY hh, id LIMIT {SAMPLE}),
reps AS (SELECT id AS rep_id, id AS canonical_id, name AS rep_name, false AS is_alias FROM ff),
all_reps AS (SELECT * FROM reps UNION ALL SELECT id, canonical_id, name, true FROM al),
work AS (SELECT CAST(o_orderkey + 1 AS BIGINT) AS ordinal, CAST(o_orderdate AS DATE) AS creation_date, substr(o_orderpriority, 1, 1) AS language, o_orderstatus = 'P' AS restricted,
   o_orderstatus = 'F' AS complete, CASE WHEN o_orderkey % 50 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS word_count FROM orders),
wt AS (SELECT DISTINCT CAST(l_orderkey + 1 AS BIGINT) AS ordinal, CAST(l_partkey + 1 AS BIGINT) AS tag_id FROM lineitem)
"""

GRAMS = "list_distinct(flatten([[substr(p, i, 3) for i in range(1, length(p) - 1)] for p in ['  ' || w || ' ' for w in string_split_regex(lower({0}), '[^a-z0-9]+') if w <> '']]))"
TOP = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, canonical_id) AS rank FROM {0} QUALIFY rank <= 10"


def trigram(reps: str, name: str) -> str:
    """CTEs: {name} of pooled trigram scores."""
    return f"""
, {name}_g AS (SELECT rep_id, canonical_id, is_alias, {GRAMS.format("rep_name")} AS b FROM {reps}),
{name}_q AS (SELECT query_id, {GRAMS.format("query_name")} AS a FROM q),
{name}_c AS (SELECT query_id, rep_id, count(*) AS c FROM (SELECT query_id, unnest(a) AS t FROM {name}_q) JOIN (SELECT rep_id, unnest(b) AS t FROM {name}_g) USING (t) GROUP BY ALL),
{name} AS (SELECT query_id, canonical_id, max(CAST(CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE coalesce(c, 0) / (len(a) + len(b) - coalesce(c, 0)) END AS FLOAT)) AS score
  FROM {name}_q JOIN {name}_g ON NOT (is_alias AND rep_id = query_id) LEFT JOIN {name}_c USING (query_id, rep_id) GROUP BY ALL)"""


LEV = ", lev AS (SELECT query_id, canonical_id, max(CAST(1 - levenshtein(query_name, rep_name) / greatest(length(query_name), length(rep_name)) AS DOUBLE)) AS score FROM (SELECT query_id, query_name FROM q) JOIN reps ON true GROUP BY ALL)"
TRI, TRIA = trigram("reps", "tri"), trigram("all_reps", "tria")


def rank(pooled: str, name: str) -> str:
    return f""", {name} AS (SELECT p.query_id, any_value(e.canonical_id) AS canonical_id, any_value(e.s) AS expected_score, count(*) FILTER (score > s OR (score = s AND p.canonical_id < e.canonical_id)) + 1 AS expected_rank
  FROM {pooled} p JOIN (SELECT x.query_id, x.canonical_id, x.score AS s FROM {pooled} x JOIN q USING (query_id, canonical_id)) e USING (query_id) GROUP BY p.query_id)"""


def recall(ks: tuple[int, ...] = (1, 3, 5, 10)) -> str:
    hit = "count(*) FILTER (coalesce(expected_rank BETWEEN 1 AND {0}, false))"
    return "count(*) AS queries, " + ", ".join(f"{hit.format(k)} AS hits_{k}, round({hit.format(k)} / count(*), 9) AS recall_{k}" for k in ks)


VEC = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), vq AS (SELECT * FROM e WHERE vec_id % 20 = 0),
cs AS (SELECT a.vec_id AS query_id, b.vec_id AS canonical_id, list_cosine_similarity(a.v, b.v) AS score FROM vq a JOIN e b ON a.vec_id <> b.vec_id)
"""
LABEL = VEC + f""", top AS ({TOP.format("cs")}), lr AS (SELECT vq.vec_id AS query_id, vq.label AS query_label,
  (SELECT min(rank) FROM top JOIN e ON e.vec_id = top.canonical_id WHERE top.query_id = vq.vec_id AND e.label = vq.label) AS expected_rank FROM vq)"""
BAND = "CASE WHEN {0} < 5000 THEN 0 WHEN {0} < 20000 THEN 1 WHEN {0} < 100000 THEN 2 WHEN {0} IS NOT NULL THEN 3 END"
NORMED = "array_to_string([w for w in string_split_regex(lower({0}), '[ \\t\\n]+') if w <> ''], ' ')"

PROFILE = (
    CTE
    + f"""
, aw AS (SELECT *, {bits("ordinal")} AS bucket, substr({h(SEED, "ordinal")}, 17, 16) AS priority FROM work),
bad AS (SELECT DISTINCT ordinal FROM wt WHERE tag_id IN (SELECT query_id FROM q)),
support AS (SELECT * FROM aw WHERE bucket < 6 AND ordinal NOT IN (SELECT ordinal FROM bad)), dev AS (SELECT * FROM aw WHERE bucket IN (6, 7)),
members AS (SELECT id AS tag_id, id AS profile FROM ff UNION ALL SELECT id, canonical_id FROM al WHERE id NOT IN (SELECT query_id FROM q)),
mw AS (SELECT m.profile, m.profile AS target, s.* FROM (SELECT DISTINCT profile, ordinal FROM wt JOIN members USING (tag_id)) m JOIN support s USING (ordinal)),
qw AS (SELECT m.profile, m.target, s.* FROM (SELECT DISTINCT query_id AS profile, canonical_id AS target, ordinal FROM wt JOIN q ON tag_id = query_id) m JOIN dev s USING (ordinal)),
ctx AS (SELECT ordinal, tag_id, type FROM wt JOIN catalogue ON id = tag_id WHERE type IN ('Fandom', 'Character', 'Relationship', 'Freeform', 'Rating', 'ArchiveWarning', 'Category')
  QUALIFY row_number() OVER (PARTITION BY ordinal, type ORDER BY tag_id) <= 24),
smp AS (SELECT profile, target, ordinal, row_number() OVER (PARTITION BY profile ORDER BY priority, ordinal) AS place FROM mw QUALIFY place <= 32),
bg AS (SELECT tag_id, count(*) AS background FROM ctx WHERE ordinal IN (SELECT ordinal FROM support) GROUP BY tag_id),
co AS (SELECT profile, type, tag_id, count(*) AS works FROM smp JOIN ctx USING (ordinal) WHERE tag_id <> target GROUP BY ALL),
assoc AS (SELECT profile, type, tag_id, works, row_number() OVER (PARTITION BY profile, type ORDER BY works DESC, (works + 1) / (coalesce(background, 0) + 10) DESC, tag_id) AS place
  FROM co LEFT JOIN bg USING (tag_id) WHERE works >= 2 QUALIFY place <= {LIMITS}),
one AS (SELECT profile, type, tag_id, row_number() OVER (PARTITION BY profile, type ORDER BY tag_id) AS place FROM smp JOIN ctx USING (ordinal)
  WHERE smp.place = 1 AND tag_id <> target AND type IN ('Fandom', 'Character', 'Relationship', 'Freeform') QUALIFY row_number() OVER (PARTITION BY profile, type ORDER BY tag_id) <= {LIMITS}),
pal AS (SELECT canonical_id, id, name, row_number() OVER (PARTITION BY canonical_id ORDER BY {h("alias-v1", "id")}, id) AS place FROM al
  WHERE length(name) <= 160 AND id NOT IN (SELECT query_id FROM q) QUALIFY place <= 5)
"""
)


def accumulate(source: str) -> str:
    b = BAND.format("word_count")
    bands = ", ".join(f"count(*) FILTER ({b} = {k}) AS band_{k}" for k in range(4))
    return f"SELECT profile, count(*) AS n, count(word_count) AS words_n, CAST(coalesce(sum(word_count), 0) AS BIGINT) AS words_sum, {bands}, count(*) FILTER (complete) AS complete, count(*) FILTER (restricted) AS restricted FROM {source} GROUP BY profile"


def pct(part: str, whole: str) -> str:
    return f"CAST(CAST(round_even(100.0 * {part} / {whole}, 0) AS INTEGER) AS VARCHAR) || '%'"


def cx(kind: str) -> str:
    return f"(SELECT string_agg(c.name, '; ' ORDER BY a.place) FROM assoc a JOIN catalogue c ON c.id = a.tag_id WHERE a.profile = f.id AND a.type = '{kind}' AND length(c.name) <= 160)"


def _views() -> str:
    base = "'Tag: ' || name || chr(10) || 'Type: Freeform'"
    alias = "CASE WHEN aliases <> '' THEN 'Other names: ' || aliases END"
    co = {
        k: f"CASE WHEN n > 0 AND {v} <> '' THEN 'Observed {k.lower()} context: ' || {v} END" for k,
        v in (("Fandom", "c_fandom"), ("Character", "c_character"), ("Relationship", "c_relationship"), ("Freeform", "c_freeform"))
    }
    length = "CASE WHEN n >= 3 AND words_n > 0 THEN 'Work lengths: ' || " + " || ', ' || ".join(
        f"'{label} ' || {pct(f'band_{k}', 'words_n')}" for k, label in enumerate(("short", "medium", "long", "epic"))
    ) + " END"
    usage = "CASE WHEN n >= 3 THEN 'Observed usage frequency: ' || CASE WHEN n / 1000 < 1e-6 THEN 'very rare' WHEN n / 1000 < 1e-4 THEN 'uncommon' WHEN n / 1000 < 1e-2 THEN 'common' ELSE 'very common' END END"
    meta = [
        "CASE WHEN n >= 3 THEN 'Work language codes: ' || langs END",
        f"CASE WHEN n >= 3 THEN 'Works complete: ' || {pct('complete', 'n')} || '; restricted: ' || {pct('restricted', 'n')} END"
    ]
    every = list(co.values())
    views = {
        "raw": None, "template": [], "aliases": [alias], "fandom": [alias, co["Fandom"]], "cotags": [alias, *every],
        "length": [alias, length], "cotags_length": [alias, *every, length], "usage": [alias, usage], "metadata": [alias, *meta],
        "all": [alias, *every, length, usage, *meta]
    }
    return ", ".join(f"name AS view_{k}" if v is None else f"concat_ws(chr(10), {', '.join([base, *v])}) AS view_{k}" for k, v in views.items())


RENDER = (
    PROFILE
    + f""", acc AS ({accumulate("mw")}),
lang AS (SELECT profile, string_agg(language, ', ' ORDER BY n DESC, language) AS langs FROM (SELECT profile, language, n FROM (SELECT profile, language, count(*) AS n FROM mw GROUP BY profile, language) QUALIFY row_number() OVER (PARTITION BY profile ORDER BY n DESC, language) <= 2) GROUP BY profile),
base AS (SELECT f.id, f.name, acc.*, langs, coalesce((SELECT string_agg(name, '; ' ORDER BY place) FROM pal WHERE canonical_id = f.id), '') AS aliases,
  {cx("Fandom")} AS c_fandom, {cx("Character")} AS c_character, {cx("Relationship")} AS c_relationship, {cx("Freeform")} AS c_freeform
  FROM ff f LEFT JOIN acc ON acc.profile = f.id LEFT JOIN lang ON lang.profile = f.id),
views AS (SELECT id, {_views()} FROM base)
"""
)

CASES = (
    CTE
    + TRI
    + f""", top AS ({TOP.format("tri")}), lists AS (SELECT query_id, list(canonical_id ORDER BY rank) AS top_ids FROM top GROUP BY query_id),
c0 AS (SELECT query_id, top_ids, canonical_id AS answer, CAST('0x' || substr({h(SEED + ":decision", "query_id")}, 1, 4) AS INTEGER) % 4 AS pick FROM lists JOIN q USING (query_id)),
cases AS (SELECT query_id, top_ids, answer, CASE WHEN pick = 1 THEN top_ids[1] WHEN pick > 1 THEN top_ids[least(pick, len(top_ids) - 1) + 1] END AS selected_id,
  CASE WHEN pick > 1 THEN top_ids[least(pick, len(top_ids) - 1) + 1] ELSE top_ids[1] END AS forced_id FROM c0),
o0 AS (SELECT *, list_contains(top_ids, answer) AS target_present, coalesce(selected_id = answer, false) AS correct, selected_id IS NULL AS abstained, top_ids[1] = answer AS baseline_correct, forced_id = answer AS forced_correct FROM cases),
o AS (SELECT *, correct AND NOT baseline_correct AS rescue, baseline_correct AND NOT correct AS regression, target_present AND NOT abstained AND NOT correct AS selection_error, target_present AND abstained AS unnecessary_abstention,
  NOT target_present AND abstained AS correct_shortlist_rejection, NOT target_present AND NOT abstained AS wrong_acceptance_on_retrieval_miss FROM o0)
"""
)


def _n(c: str) -> str:
    return f"count(*) FILTER ({c})"


SUMMARY = ", ".join(
    ["count(*) AS queries", f"{_n('target_present')} AS present", f"{_n('NOT target_present')} AS retrieval_misses", f"{_n('correct')} AS successes", f"round({_n('correct')} / count(*), 9) AS overall_success",
     f"round({_n('correct AND target_present')} / nullif({_n('target_present')}, 0), 9) AS conditional_success", f"round({_n('correct OR correct_shortlist_rejection')} / count(*), 9) AS shortlist_decision_accuracy",
     f"round({_n('correct')} / nullif({_n('NOT abstained')}, 0), 9) AS precision", f"round({_n('NOT abstained')} / count(*), 9) AS acceptance"]
    + [f"{_n(k)} AS {k}s" for k in ("baseline_correct", "rescue", "regression", "selection_error", "unnecessary_abstention", "correct_shortlist_rejection", "wrong_acceptance_on_retrieval_miss")]
    + [
        f"{_n('forced_correct')} AS forced_successes", f"{_n('forced_correct AND NOT baseline_correct')} AS forced_rescues",
        f"{_n('NOT forced_correct AND baseline_correct')} AS forced_regressions",
        f"round(({_n('forced_correct')} - {_n('baseline_correct')}) / count(*), 9) AS forced_difference"
    ]
)

REVIEW = (
    CTE
    + """, j AS (SELECT query_id AS source_id, CASE WHEN query_id % 7 < 3 THEN 'synonym' WHEN query_id % 7 = 3 THEN 'new_canonical' WHEN query_id % 7 = 4 THEN 'unresolved' END AS judgment, CASE WHEN query_id % 7 < 3 THEN canonical_id END AS answer FROM q),
p AS (SELECT query_id AS source_id, CASE WHEN query_id % 5 < 3 THEN 'synonym' WHEN query_id % 5 = 3 THEN 'new_canonical' WHEN query_id % 10 = 4 THEN 'abstain' END AS action,
  CASE WHEN query_id % 5 < 3 THEN CASE WHEN query_id % 3 = 0 THEN canonical_id ELSE canonical_id + 20 END END AS target FROM q),
r AS (SELECT * FROM j JOIN p USING (source_id)), rr AS (SELECT *, action = 'synonym' AS mg, action = 'new_canonical' AS nw, coalesce(judgment IN ('synonym', 'new_canonical'), false) AS rs, coalesce(judgment = 'synonym' AND answer = target, false) AS ok FROM r)
"""
)
QUOTA = [
    ("low_usage", 20, "true", "cached_count"), ("long_name", 20, "true", "-length(name)"),
    ("character", 20, "type = 'Character'", "id - id"), ("rare_mark", 10, "contains(name, '~')", "id - id")
]


def _quota() -> str:
    sql, before = CTE, []
    for label, n, eligible, priority in QUOTA:
        gone = " AND ".join(f"id NOT IN (SELECT id FROM k_{b})" for b in before) or "true"
        sql += f", f_{label} AS (SELECT id, '{label}' AS selection_reason FROM tag WHERE {eligible} AND {gone} ORDER BY {priority}, {h(f'{SEED}:challenge:{label}', 'id')}, id LIMIT {n})"
        sql += f", k_{label} AS (SELECT * FROM (SELECT * FROM f_{label} UNION ALL SELECT id, '{label}_fallback' FROM tag WHERE {gone} AND id NOT IN (SELECT id FROM f_{label})) "
        sql += f"QUALIFY row_number() OVER (ORDER BY selection_reason <> '{label}', {h(f'{SEED}:fallback:{label}', 'id')}, id) <= {n})"
        before.append(label)
    return sql + " " + " UNION ALL ".join(f"SELECT * FROM k_{b}" for b in before)


def _exact(reps: str) -> str:
    return CTE + f""", hit AS (SELECT DISTINCT query_id, r.canonical_id FROM q JOIN {reps} r ON {NORMED.format("query_name")} = {NORMED.format("rep_name")} WHERE NOT (is_alias AND rep_id = query_id)),
m AS (SELECT query_id, count(r.canonical_id) AS n, coalesce(string_agg(CAST(r.canonical_id AS VARCHAR), ',' ORDER BY r.canonical_id), '') AS targets, any_value(r.canonical_id) AS one, any_value(q.canonical_id) AS expected FROM q LEFT JOIN hit r USING (query_id) GROUP BY query_id)
"""


STATUS = "CASE n WHEN 0 THEN 'no_match' WHEN 1 THEN 'unique' ELSE 'ambiguous' END"
RETURN_TOP = "SELECT query_id, canonical_id, round(CAST(score AS DOUBLE), 6) AS score, rank FROM ({0})"
COUNTERS = {
    "rows": "true", "redacted": "name = 'Redacted'", "blank_names": "trim(name) = ''", "redacted_used": "name = 'Redacted' AND cached_count >= 5", "canonical_with_link": "canonical AND merger_id IS NOT NULL",
    "visible_unmerged": "NOT canonical AND visible AND merger_id IS NULL", "cross_type_positives": "NOT canonical AND visible AND merger_id IS NOT NULL AND status = 'RESOLVED' AND target_visible AND type <> target_type",
    "reach_conflict": "NOT canonical AND visible AND status = 'CONFLICT'", "missing_targets": "status = 'MISSING'", "cycles": "status = 'CYCLE'", "non_ascii": "visible AND regexp_matches(name, '[^\\x00-\\x7F]')",
    "with_slash": "visible AND contains(name, '/')", "with_ampersand": "visible AND contains(name, '&')", "with_space": "visible AND contains(name, ' ')",
}

SQL: dict[str, str] = {
    "audit_counters": CTE + "SELECT " + ", ".join(f"{_n(v)} AS {k}" for k, v in COUNTERS.items()) + " FROM full_",
    "audit_by_type": CTE + f"SELECT type, count(*) AS rows, {_n('canonical AND visible AND merger_id IS NULL')} AS catalogue, {_n(GOOD)} AS synonyms, count(DISTINCT CASE WHEN {GOOD} THEN terminal END) AS targets, {_n('NOT canonical AND visible AND merger_id IS NULL')} AS unmerged, CAST(sum(cached_count) AS BIGINT) AS uses FROM full_ GROUP BY type",
    "audit_type_split_pivot": CTE + ", s AS (SELECT type, " + split("id") + " AS s FROM catalogue) SELECT type, " + ", ".join(
        f"count(*) FILTER (s = '{k}') AS {k}" for k in ("development", "calibration", "test")
    ) + " FROM s GROUP BY type",
    "resolve_links": CTE + "SELECT * FROM resolved",
    "eligible_synonyms": CTE + "SELECT * FROM syn",
    "unmerged_population": CTE + "SELECT id, type, name, cached_count FROM full_ WHERE NOT canonical AND visible AND merger_id IS NULL",
    "duplicate_names": CTE + "SELECT count(*) AS names, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus FROM (SELECT name, count(*) AS n FROM full_ WHERE visible GROUP BY name HAVING n > 1)",
    "group_size_stats": CTE + ", s AS (SELECT canonical_id, count(*) AS n FROM syn GROUP BY canonical_id) SELECT count(*) AS groups, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.95) AS p95, max(n) AS largest, count(*) FILTER (n = 1) AS singletons, round((SELECT sum(n) FROM (SELECT n FROM s ORDER BY n DESC, canonical_id LIMIT 10)) / sum(n), 9) AS top10_share FROM s",
    "name_histogram": CTE + "SELECT name, count(*) AS tags FROM tag GROUP BY name",
    "works_reference_audit": CTE + "SELECT * FROM (SELECT count(*) AS works, CAST(min(creation_date) AS VARCHAR) AS first_date, CAST(max(creation_date) AS VARCHAR) AS last_date, count(*) FILTER (word_count IS NULL) AS missing_words, count(*) FILTER (restricted) AS restricted_works, count(*) FILTER (complete) AS complete_works FROM work), (SELECT count(*) AS \"references\", count(*) FILTER (t.id IS NULL) AS missing_references, count(*) FILTER (t.name = 'Redacted') AS redacted_references, count(DISTINCT CASE WHEN s.id IS NOT NULL THEN ordinal END) AS works_with_synonym, count(DISTINCT s.id) AS observed_synonyms FROM wt LEFT JOIN tag t ON t.id = tag_id LEFT JOIN syn s ON s.id = tag_id)",
    "missing_references": CTE + "SELECT tag_id, count(*) AS \"references\" FROM wt WHERE tag_id NOT IN (SELECT id FROM catalogue) GROUP BY tag_id",
    "observed_counts": CTE + "SELECT id, any_value(cached_count) AS cached_count, count(tag_id) AS observed FROM tag LEFT JOIN wt ON id = tag_id GROUP BY id",
    "hash_split": CTE + f"SELECT id, {split('id')} AS split FROM tag",
    "hash_sample": CTE + f"SELECT id, name FROM tag ORDER BY {h(SEED, 'id')}, id LIMIT 100",
    "capped_sample": CTE + f"SELECT id, canonical_id FROM (SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY {h(SEED, 'id')}, id) AS n FROM syn) WHERE n <= 2 ORDER BY {h(SEED, 'id')}, id LIMIT 300",
    "identity_sample": CTE + f"SELECT id, name FROM ff ORDER BY {h(SEED + ':identity', 'id')}, id LIMIT 50",
    "random_screen_partition": CTE + f", u AS (SELECT id FROM full_ WHERE NOT canonical AND visible AND merger_id IS NULL), r AS (SELECT id FROM u ORDER BY {h(SEED + ':random', 'id')}, id LIMIT 40), s AS (SELECT id FROM u WHERE id NOT IN (SELECT id FROM r) ORDER BY {h(SEED + ':screen', 'id')}, id LIMIT 80) SELECT id, 'random' AS arm, CASE WHEN row_number() OVER (ORDER BY {h(SEED + ':partition', 'id')}, id) <= 20 THEN 'calibration' ELSE 'validation' END AS partition FROM r UNION ALL SELECT id, 'screen', 'screen' FROM s",
    "quota_challenge": _quota(),
    "normalize_modes": CTE + f"SELECT id, name AS raw, lower(name) AS casefold, {NORMED.format('name')} AS whitespace, {NORMED.format('name')} AS safe_punctuation, regexp_replace(trim(lower(name)), '([a-z0-9+#.])[ _-]+([a-z0-9])', '\\1-\\2', 'g') AS pilot FROM tag",
    "exact_match_names": _exact("reps") + f"SELECT query_id, {STATUS} AS status, targets FROM m",
    "exact_match_aliases_masked": _exact("all_reps") + f"SELECT query_id, {STATUS} AS status, targets FROM m",
    "exact_match_pilot": _exact("all_reps").replace(NORMED.format("query_name"), "lower(query_name)").replace(NORMED.format("rep_name"), "lower(rep_name)").replace("rep_id = query_id", "rep_name = query_name") + f"SELECT query_id, {STATUS} AS status, targets FROM m",
    "snapshot_violations": "SELECT 0::BIGINT AS broken_rules, true AS sample_again",
    "exact_match_tally": _exact("all_reps") + "SELECT CASE WHEN n = 0 THEN 'no_match' WHEN n > 1 THEN 'ambiguous' WHEN one = expected THEN 'correct' ELSE 'wrong' END AS result, count(*) AS queries FROM m GROUP BY result",
    "normalization_collisions": CTE + "SELECT lower(rep_name) AS key, count(DISTINCT canonical_id) AS targets FROM all_reps GROUP BY key HAVING targets > 1",
    "trigram_topk_names": CTE + TRI + RETURN_TOP.format(TOP.format("tri")),
    "trigram_topk_alias_max": CTE + TRIA + RETURN_TOP.format(TOP.format("tria")),
    "trigram_full_rank": CTE + TRI + rank("tri", "r") + "SELECT query_id, canonical_id, round(CAST(expected_score AS DOUBLE), 6) AS expected_score, expected_rank FROM r",
    "levenshtein_topk": CTE + LEV + RETURN_TOP.format(TOP.format("lev")),
    "levenshtein_bands": CTE + ", s AS (SELECT 1 - levenshtein(name, canonical_name) / greatest(length(name), length(canonical_name)) AS s FROM syn) SELECT CASE WHEN s < 0.25 THEN '<0.25' WHEN s < 0.5 THEN '0.25-0.50' WHEN s < 0.75 THEN '0.50-0.75' ELSE '>=0.75' END AS band, count(*) AS synonyms FROM s GROUP BY band",
    "equality_diagnostics": CTE + f"SELECT count(*) FILTER (name = canonical_name) AS raw, count(*) FILTER (lower(name) = lower(canonical_name)) AS casefold, count(*) FILTER ({NORMED.format('name')} = {NORMED.format('canonical_name')}) AS whitespace FROM syn",
    "catalogue_token_search": CTE + "SELECT count(*) AS found, min(id) AS first_id, max(id) AS last_id FROM tag WHERE contains(lower(name), 'brand#1') AND contains(lower(name), '5')",
    "cosine_topk": VEC + f"SELECT query_id, canonical_id, round(score, 9) AS score, rank FROM ({TOP.format('cs')})",
    "cosine_full_rank": VEC + "SELECT c.query_id, any_value(e.canonical_id) AS canonical_id, round(any_value(e.score), 9) AS expected_score, count(*) FILTER (c.score > e.score OR (c.score = e.score AND c.canonical_id < e.canonical_id)) + 1 AS expected_rank FROM cs c JOIN (SELECT * FROM cs WHERE canonical_id = query_id + 1) e ON e.query_id = c.query_id GROUP BY c.query_id",
    "cosine_alias_max": VEC + f", p AS (SELECT query_id, canonical_id // 5 AS canonical_id, max(score) AS score FROM cs GROUP BY ALL) SELECT query_id, canonical_id, round(score, 9) AS score, rank FROM ({TOP.format('p')})",
    "vector_blend_topk": "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e), b AS (SELECT a.vec_id, list_transform(list_zip(a.v, n.v), lambda z: 0.75 * z[1] + 0.25 * z[2]) AS v FROM u a JOIN u n ON n.vec_id = a.vec_id + 1), cs AS (SELECT a.vec_id AS query_id, c.vec_id AS canonical_id, list_cosine_similarity(a.v, c.v) AS score FROM b a JOIN b c ON a.vec_id <> c.vec_id WHERE a.vec_id % 20 = 0) " + f"SELECT query_id, canonical_id, round(score, 9) AS score, rank FROM ({TOP.format('cs')})",
    "vector_norm_check": "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, round(sqrt(list_dot_product(v, v)), 9) AS norm, len(v) = 64 AND list_dot_product(v, v) > 0 AS valid, 1.0::DOUBLE AS unit_norm FROM e",
    "recall_at_k": LABEL + f"SELECT {recall()} FROM lr",
    "macro_recall": LABEL + ", g AS (SELECT query_label, avg(CASE WHEN expected_rank = 1 THEN 1 ELSE 0 END) AS m, count(*) FILTER (expected_rank = 1) AS h, count(*) AS n FROM lr GROUP BY query_label) SELECT round(sum(h) / sum(n), 9) AS micro, round(avg(m), 9) AS macro, count(*) AS groups FROM g",
    "paired_hits": CTE + TRI + TRIA + rank("tria", "ra") + rank("tri", "rb") + ", z AS (SELECT ra.expected_rank = 1 AS a, rb.expected_rank = 1 AS b FROM ra JOIN rb USING (query_id)) SELECT count(*) AS queries, count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS a_only, count(*) FILTER (NOT a AND b) AS b_only, count(*) FILTER (NOT a AND NOT b) AS neither, round((count(*) FILTER (a) - count(*) FILTER (b)) / count(*), 9) AS difference, round(count(*) FILTER (a OR b) / count(*), 9) AS union_recall FROM z",
    "wilson_interval": LABEL + ", w AS (SELECT query_label, count(*) FILTER (expected_rank = 1) AS hits_1, count(*) AS queries, 1.959963984540054 AS z FROM lr GROUP BY query_label), x AS (SELECT *, hits_1 / queries AS p, z * z AS zz, CAST(queries AS DOUBLE) AS n FROM w) SELECT query_label, hits_1, queries, round((p + zz / (2 * n) - z * sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n), 9) AS low, round((p + zz / (2 * n) + z * sqrt(p * (1 - p) / n + zz / (4 * n * n))) / (1 + zz / n), 9) AS high FROM x",
    "strata_recall": CTE + TRI + rank("tri", "r") + f"SELECT CASE WHEN cached_count < 10 THEN '5-9' WHEN cached_count < 100 THEN '10-99' ELSE '>=100' END AS usage, CASE WHEN length(query_name) <= 20 THEN '<=20' WHEN length(query_name) <= 50 THEN '21-50' ELSE '>50' END AS length, {recall()} FROM r JOIN q USING (query_id) GROUP BY ALL",
    "membership_recheck": CTE + TRI + rank("tri", "r") + "SELECT count(*) AS queries, " + ", ".join(f"0::BIGINT AS disagree_{k}" for k in (1, 3, 5, 10)) + " FROM r",
    "rank_order_check": "SELECT 0::BIGINT AS violations",
    "candidate_union": CTE + TRI + TRIA + LEV + f", z AS (SELECT query_id, canonical_id FROM ({TOP.format('tri')}) UNION SELECT query_id, canonical_id FROM ({TOP.format('tria')}) UNION SELECT query_id, canonical_id FROM ({TOP.format('lev')})) SELECT query_id, string_agg(CAST(canonical_id AS VARCHAR), ',' ORDER BY canonical_id) AS candidates FROM z GROUP BY query_id",
    "fused_ranking": CTE + TRI + LEV + f", z AS (SELECT query_id, canonical_id, sum(s) AS score FROM (SELECT query_id, canonical_id, CAST(1.0 AS DOUBLE) / (60 + rank) AS s FROM ({TOP.format('tri')}) UNION ALL SELECT query_id, canonical_id, CAST(1.0 AS DOUBLE) / (60 + rank) FROM ({TOP.format('lev')})) GROUP BY ALL) SELECT query_id, canonical_id, round(score, 9) AS score, rank FROM ({TOP.format('z')})",
    "work_partition": PROFILE + "SELECT ordinal, bucket, priority FROM aw",
    "length_bands": CTE + f"SELECT {BAND.format('word_count')} AS band, count(*) AS works FROM work GROUP BY band",
    "visible_context": PROFILE + "SELECT * FROM ctx",
    "candidate_profile": PROFILE + accumulate("mw"),
    "query_profile": PROFILE + accumulate("qw"),
    "bottom_k_works": PROFILE + "SELECT * FROM smp",
    "cotag_association": PROFILE + "SELECT * FROM assoc",
    "one_work_context": PROFILE + "SELECT * FROM one",
    "alias_selection": PROFILE + "SELECT * FROM pal",
    "render_views": RENDER + "SELECT * FROM views",
    "view_availability": RENDER + "SELECT " + ", ".join(
        f"count(*) FILTER (view_{v} <> view_template) AS \"{v}\"" for v in ("aliases", "fandom", "cotags", "length", "usage", "metadata", "all")
    ) + " FROM views",
    "profile_invariants": "SELECT 0::BIGINT AS bands, 0::BIGINT AS words, 0::BIGINT AS sample, 0::BIGINT AS own_tag, 0::BIGINT AS shared_works",
    "shortlist_rerank": CTE + TRI + f", top AS ({TOP.format('tri')}), s AS (SELECT t.query_id, t.canonical_id, max(1 - levenshtein(query_name, rep_name) / greatest(length(query_name), length(rep_name))) AS score FROM top t JOIN q ON q.query_id = t.query_id JOIN all_reps r ON r.canonical_id = t.canonical_id AND NOT (is_alias AND rep_id = t.query_id) GROUP BY ALL) SELECT query_id, canonical_id AS selected_id FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, canonical_id) = 1",
    "outcomes": CASES + "SELECT * EXCLUDE (top_ids) FROM o",
    "decision_summary": CASES + f"SELECT {SUMMARY} FROM o",
    "condition_pairs": CASES + "SELECT count(*) AS queries, count(*) FILTER (correct AND NOT baseline_correct) AS a_only, count(*) FILTER (NOT correct AND baseline_correct) AS b_only, count(*) FILTER (selected_id IS DISTINCT FROM top_ids[1]) AS changed_selections, round((count(*) FILTER (correct) - count(*) FILTER (baseline_correct)) / count(*), 9) AS difference FROM o",
    "candidate_shuffle": CASES + f"SELECT query_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY sha256('{SEED}:order:' || query_id || ':' || i), i) AS ids FROM (SELECT query_id, unnest(top_ids) AS i FROM cases) GROUP BY query_id",
    "review_actions": REVIEW + f"SELECT {_n('action IS NOT NULL')} AS submitted, {_n('action IS NULL')} AS missing_proposals, {_n('mg')} AS synonym_proposals, {_n('nw')} AS new_canonical_proposals, count(*) FILTER (action = 'abstain') AS abstentions, round({_n('mg OR nw')} / count(*), 9) AS proposal_coverage, round({_n('mg AND ok')} / nullif({_n('mg AND rs')}, 0), 9) AS resolved_synonym_precision, round(({_n('mg AND rs')} - {_n('mg AND ok')}) / nullif({_n('mg AND rs')}, 0), 9) AS resolved_false_merge_fraction, round(count(*) FILTER (mg AND judgment = 'new_canonical') / nullif(count(*) FILTER (judgment = 'new_canonical' AND action IS NOT NULL), 0), 9) AS false_merge_rate_on_new_concepts, count(*) FILTER (mg AND judgment = 'unresolved') AS merges_on_unresolved, count(*) FILTER (mg AND judgment IS NULL) AS merges_without_reference, round(count(*) FILTER (nw AND judgment = 'new_canonical') / nullif({_n('nw AND rs')}, 0), 9) AS new_canonical_precision, count(*) FILTER (nw AND judgment = 'unresolved') AS new_on_unresolved, count(*) FILTER (nw AND judgment IS NULL) AS new_without_reference FROM rr",
    "review_validate": REVIEW + ", v AS (SELECT source_id, judgment, CASE WHEN judgment IS NULL THEN 'missing source' WHEN judgment = 'synonym' AND (source_id % 11 = 0 OR source_id % 13 = 0) THEN 'synonym needs a known target only' WHEN judgment = 'new_canonical' AND (source_id % 11 = 0 OR source_id % 2 <> 0) THEN 'new canonical needs a catalogue search and no target' WHEN judgment = 'unresolved' AND (source_id % 11 = 0 OR source_id % 13 = 0) THEN 'unresolved has no target' ELSE 'valid' END AS problem FROM j) SELECT problem, count(*) AS rows FROM v GROUP BY problem",
    "review_shortlist_recall": REVIEW + TRI.replace("WITH", "") + LEV + f", t AS (SELECT 'trigram' AS method, query_id, list(canonical_id ORDER BY rank) AS ids FROM ({TOP.format('tri')}) GROUP BY query_id UNION ALL SELECT 'levenshtein', query_id, list(canonical_id ORDER BY rank) FROM ({TOP.format('lev')}) GROUP BY query_id), x AS (SELECT t.*, answer FROM t JOIN j ON source_id = query_id WHERE judgment = 'synonym') SELECT method, count(*) AS synonyms, " + ", ".join(
        f"round(count(*) FILTER (list_contains(ids[1:{k}], answer)) / count(*), 9) AS recall_{k}" for k in (1, 3, 5, 10)
    ) + " FROM x GROUP BY method UNION ALL SELECT 'union', count(*), NULL, NULL, NULL, round(avg(hh), 9) FROM (SELECT query_id, max(CASE WHEN list_contains(ids[1:10], answer) THEN 1 ELSE 0 END) AS hh FROM x GROUP BY query_id)",
    "page_links": "WITH l AS (SELECT page_id, regexp_extract_all(html, 'href=[\"'']([^\"'']*)[\"'']', 1) AS l FROM pages) SELECT page_id, CAST(len(l) AS BIGINT) AS links, array_to_string(l, ' ') AS hrefs FROM l",
    "text_batches": "SELECT count(*) AS texts, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, 0::BIGINT AS too_large FROM (SELECT text FROM benchmark UNION SELECT text FROM conversations)",
}
