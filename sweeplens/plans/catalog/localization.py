"""Patches, distractors, examples, ranked answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sweeplens.functions import text as X
from sweeplens.operators import localization as Z
from sweeplens.plans import fixtures as fx
from sweeplens.session import pin, spread


def patch_files(spark, d):
    out = Z.changed_files(fx.patches(spark, d)).select("issue_id", F.posexplode("changed").alias("pos", "c"))
    return out.select("issue_id", "pos", F.col("c.path").alias("path"), F.array_join("c.starts", ",").alias("starts"))


def file_patch(spark, d):
    rows = Z.changed_files(fx.patches(spark, d), include_tests=True)
    last = F.element_at("changed", -1)["path"]
    return rows.select("issue_id", last.alias("path"), F.size("changed").alias("files"),
                       F.md5(Z.file_patch(F.col("patch"), last)).alias("block_md5"))


def path_classes(spark, d):
    rows = fx.files(spark, d).select(
        "repo", "path", X.is_source_path(F.col("path")).alias("source"), X.is_test_path(F.col("path")).alias("test"),
        X.suffix(F.col("path")).alias("suffix"), X.parent_dir(F.col("path")).alias("dir"))
    return rows.withColumn("depth", X.dir_depth(F.col("dir")))


def distractors(spark, d):
    files = fx.files(spark, d)
    truths = files.filter(X.is_source_path(F.col("path"))).select("repo", F.col("path").alias("truth"))
    return Z.choose_distractors(truths, files, 6).select("repo", "truth", "path", "position", "other_dir", "depth_gap")


def snippets(spark, d):
    out = Z.file_snippets(fx.files(spark, d), 12)
    return out.select("repo", "path", "n_lines", "focus_line", "start_line", "end_line", F.md5("code_snippet").alias("snippet_md5"))


def _examples(spark, d, issues):
    return Z.build_examples(issues, spread(fx.files(spark, d)), distractors=3, snippet_lines=12, min_lines=4)


def examples(spark, d):
    out = _examples(spark, d, fx.patches(spark, d))
    paths = F.array_sort(F.transform("candidate_files", lambda c: c["file_path"]))
    return out.select("issue_id", "skip_reason", "ground_truth", F.array_join(paths, ",").alias("candidates"))


def skip_report(spark, d):
    scanned = pin(Z.scan_order(fx.patches(spark, d), seed=42, limit=200))  # read by both passes, and twice by the report
    out = Z.keep_report(_examples(spark, d, scanned), max_examples=15)
    return out.select("scan_pos", "issue_id", "decision", "skip_reason")


def shuffle_positions(spark, d):
    rows = fx.localization(spark, d).select("issue_id", "file_path")
    return Z.shuffled(rows, 7, ["file_path"], per=["issue_id"])


def text_search(spark, d):
    out = Z.search_text(fx.files(spark, d), ["the ", "ion", "e.", "qq"], 20)
    return out.select("repo", "query", "hit", "path", "line", F.md5("line_text").alias("text_md5"))


def _answers(spark, d):
    """Candidates in h order, an answer naming the dearer half, one true file per issue."""
    rows = fx.localization(spark, d)
    grouped = rows.groupBy("issue_id", "condition").agg(
        F.array_sort(F.collect_list(F.struct("h", "file_path"))).alias("c"),
        F.array_sort(F.collect_list(F.struct((-F.col("price")).alias("p"), "file_path"))).alias("p"),
        F.min_by("file_path", F.md5(F.concat(F.lit("t"), "h"))).alias("ground_truth"))
    half = F.floor((F.size("p") + 1) / 2).cast("int")
    named = F.transform(F.slice("p", F.lit(1), half), lambda x: x["file_path"])
    quoted = F.concat(F.lit('["'), F.array_join(named, '","'), F.lit('"]'))
    text = (
        F.when(F.col("issue_id") % 4 == 0, F.concat(F.lit('Sure: {"ranked_files": '), quoted, F.lit(', "rationale": "a {b} \\" c"} done')))
        .when(F.col("issue_id") % 4 == 1, F.concat(F.lit('{"ranking": ["x"], "ranking": '), quoted, F.lit(', "score": NaN}')))
        .when(F.col("issue_id") % 4 == 2, F.concat(F.lit("First "), F.array_join(named, " then ")))
        .otherwise(F.lit("no clue {")))
    return grouped.select(
        "issue_id", "condition", "ground_truth", F.transform("c", lambda x: x["file_path"]).alias("candidate_paths"),
        text.alias("raw_answer"))


def ranked_parse(spark, d):
    out = Z.parse_rankings(_answers(spark, d))
    return out.select("issue_id", F.array_join("ranked_files", ",").alias("ranked"), "parser", "valid_ranked_count",
                      "completed_missing_candidates")


def _scored(spark, d):
    return Z.score_rankings(Z.parse_rankings(_answers(spark, d)))


def rank_scores(spark, d):
    return _scored(spark, d).select("issue_id", "rank", "top1", "top3", F.round("mrr", 9).alias("mrr"))


def localization_summary(spark, d):
    out = Z.summarize(_scored(spark, d))
    return out.select("condition", "n", *[F.round(c, 9).alias(c) for c in ("top1_accuracy", "top3_accuracy", "mrr", "avg_rank")])


def localization_pending(spark, d):
    orders = fx.table(spark, d, "orders")
    issues = orders.select(F.col("o_orderkey").alias("issue_id"))
    conditions = orders.select(F.col("o_orderpriority").alias("condition")).distinct()
    done = orders.select(F.col("o_orderpriority").alias("condition"), F.col("o_orderkey").alias("issue_id"))
    return Z.pending_pairs(issues, conditions, done)


def localization_window(spark, d):
    """Pending pairs of the two hundred orders from the hundredth on, by order date."""
    orders = fx.table(spark, d, "orders")
    issues = orders.select(F.col("o_orderkey").alias("issue_id"), "o_orderdate")
    conditions = orders.select(F.col("o_orderpriority").alias("condition")).distinct()
    done = orders.select(F.col("o_orderpriority").alias("condition"), F.col("o_orderkey").alias("issue_id"))
    return Z.pending_pairs(issues, conditions, done, start=100, count=200, order=["o_orderdate", "issue_id"]).select("issue_id", "condition")


QUERIES = {
    f.__name__: f for f in (
        patch_files, file_patch, path_classes, distractors, snippets, examples, skip_report, shuffle_positions,
        text_search, ranked_parse, rank_scores, localization_summary, localization_pending,
        localization_window)
}

_DOC = "(o_orderkey % (select count(*) from documents))"
_P = f"'src/m' || ({_DOC} % 7) || '/f' || {_DOC} || '.py'"

FILES_SQL = f"fk as ({fx.FILES_KEYS_BODY}), files as (select fk.repo, fk.path, fk.doc_id, d.text from fk join documents d using (doc_id))"
CLASSES_SQL = f"""{FILES_SQL}, cls as (select repo, path, text, path like 'tests/%' as test,
  regexp_extract(path, '(\\.[a-z]+)$', 1) as suffix, regexp_replace(path, '/[^/]*$', '') as dir from files)"""
LINES = "string_split(text, chr(10))"
# The texts hold no other terminator than a line feed, and no trailing one is kept as a line.
LINED_SQL = f"lined as (select *, case when text = '' then [] when right(text, 1) = chr(10) then {LINES}[1:len({LINES})-1] else {LINES} end as ls from cls)"
CHOSEN_SQL = """
 chosen as (select * from (select t.repo, t.path as truth, f.path, cast(case when f.dir = t.dir then 0 else 1 end as int) as other_dir,
   cast(abs(len(string_split(f.dir, '/')) - len(string_split(t.dir, '/'))) as int) as depth_gap,
   row_number() over (partition by t.repo, t.path order by case when f.dir = t.dir then 0 else 1 end,
     abs(len(string_split(f.dir, '/')) - len(string_split(t.dir, '/'))), f.path) as position
  from cls t join cls f on f.repo = t.repo and f.suffix = t.suffix and f.path <> t.path and not f.test and f.dir like 'src%'
  where not t.test) where position <= {k})
"""


def _snip(lines: str, center: str, size: int) -> str:
    """start (0-based) and end of a clamped window as two SQL expressions."""
    mid = f"greatest(0, least(len({lines}) - 1, {center} - 1))"
    end = f"least(len({lines}), greatest(0, {mid} - {size // 2}) + {size})"
    return f"greatest(0, {end} - {size}) as s, {end} as e"


SNIPPET_SQL = f"""{CLASSES_SQL}, {LINED_SQL},
 foc as (select *, coalesce(nullif(list_position(list_transform(ls, lambda l: trim(l, ' ' || chr(9)) <> '' and not regexp_matches(trim(l, ' ' || chr(9)), '^(#|//|/\\*|\\*)')
   and regexp_matches(l, '^\\s*(def|class|async def)\\s+|^\\s*(function|export function|export class|class)\\s+|^\\s*(public|private|protected)?\\s*(class|interface|void|int|String|boolean)\\s+')), true), 0),
   nullif(list_position(list_transform(ls, lambda l: trim(l, ' ' || chr(9)) <> ''), true), 0), 1) as focus from lined),
 sn as (select *, {_snip('ls', 'focus', 12)} from foc),
 snip as (select repo, path, len(ls) as n_lines, focus, case when len(ls) = 0 then 1 else s + 1 end as start_line, case when len(ls) = 0 then 1 else e end as end_line,
   array_to_string(ls[s + 1 : e], chr(10)) as body from sn)
"""


def _count_lines(body: str) -> str:
    return f"(case when {body} = '' then 0 else len(string_split({body}, chr(10))) - cast(right({body}, 1) = chr(10) as int) end)"


EXAMPLES_SQL = f"""{SNIPPET_SQL}, {CHOSEN_SQL.format(k=3)},
 p as (select o_orderkey as issue_id, 'repo' || ({_DOC} % 4) as repo, {_P} as truth, 1 + o_custkey % 40 as center,
   case when o_orderkey % 3 <> 0 and o_orderkey % 5 = 0 then 2 else 1 end as n_changed from orders),
 own as (select p.*, ls, {_snip('ls', 'center', 12)} from p left join lined l on l.repo = p.repo and l.path = p.truth),
 ok as (select c.repo, c.truth, count(*) as found, count(*) filter (where n_lines >= 4 and {_count_lines('body')} >= 4) as usable,
   string_agg(c.path, ',' order by c.path) as paths from chosen c left join snip s on s.repo = c.repo and s.path = c.path group by 1, 2),
 ex as (select issue_id, own.truth, paths, case when n_changed > 1 then 'patch changes 2 source files'
   when ls is null then 'correct file missing/unreadable: ' || own.truth
   when len(ls) < 4 then 'correct file too short: ' || own.truth
   when {_count_lines("array_to_string(ls[s + 1 : e], chr(10))")} < 4 then 'correct snippet too short'
   when coalesce(found, 0) < 3 then 'only found ' || coalesce(found, 0) || ' distractors'
   when usable < 3 then 'not enough usable distractor snippets' end as skip_reason
  from own left join ok on ok.repo = own.repo and ok.truth = own.truth)
"""

ANSWER_SQL = f"""
 f as ({fx.LOC_BODY}),
 r as (select *, row_number() over (partition by issue_id order by h, file_path) as hpos,
   row_number() over (partition by issue_id order by price desc, file_path) as ppos, count(*) over (partition by issue_id) as n,
   row_number() over (partition by issue_id order by md5('t' || h)) as tpos from f),
 m as (select *, issue_id % 4 <> 3 and ppos <= (n + 1) // 2 as named from r),
 o as (select *, row_number() over (partition by issue_id order by case when named then 0 else 1 end,
   case when named then ppos else hpos end) as pos from m),
 res as (select issue_id, min(condition) as condition, max(case when tpos = 1 then pos end) as rank, string_agg(file_path, ',' order by pos) as ranked,
   count(*) filter (where named) as valid, count(*) as n from o group by 1)
"""

ORACLES = {
    "patch_files": f"""select o_orderkey as issue_id, 0 as pos, {_P} as path, cast(1 + o_custkey % 40 as varchar) as starts from orders
        union all select o_orderkey, 1, 'src/z.js', '9' from orders where o_orderkey % 3 <> 0 and o_orderkey % 5 = 0""",
    "file_patch": f"""with p as ({fx.PATCHES_BODY}) select issue_id,
        case when issue_id % 3 = 0 then 'tests/test_a.py' when issue_id % 5 = 0 then 'src/z.js' else {_P.replace('o_orderkey', 'issue_id')} end as path,
        case when issue_id % 3 = 0 or issue_id % 5 = 0 then 2 else 1 end as files,
        md5(case when issue_id % 3 = 0 then 'diff --git a/tests/test_a.py b/tests/test_a.py' || chr(10) || '@@ -5 +5 @@' || chr(10) || '-y'
         when issue_id % 5 = 0 then 'diff --git a/src/z.js b/src/z.js' || chr(10) || '@@ -9,2 +9,2 @@' || chr(10) || '-z' else patch end) as block_md5 from p""",
    "path_classes": f"""with {CLASSES_SQL} select repo, path, not test as source, test, suffix, dir, cast(len(string_split(dir, '/')) as int) as depth from cls""",
    "distractors": f"""with {CLASSES_SQL}, {CHOSEN_SQL.format(k=6)} select repo, truth, path, cast(position as int) as position, other_dir, depth_gap from chosen""",
    "snippets": f"""with {SNIPPET_SQL} select repo, path, cast(n_lines as int) as n_lines, cast(focus as int) as focus_line, cast(start_line as int) as start_line, cast(end_line as int) as end_line, md5(body) as snippet_md5 from snip""",
    "examples": f"""with {EXAMPLES_SQL} select issue_id, skip_reason, case when skip_reason is null then truth end as ground_truth,
        case when skip_reason is null then array_to_string(list_sort(list_append(string_split(paths, ','), truth)), ',') end as candidates from ex""",
    "skip_report": f"""with {EXAMPLES_SQL}, s as (select *, row_number() over (order by md5('42:' || issue_id), issue_id) as scan_pos from ex),
        k as (select *, coalesce(sum(cast(skip_reason is null as int)) over (order by scan_pos rows between unbounded preceding and 1 preceding), 0) as kept from s where scan_pos <= 200)
        select cast(scan_pos as int) as scan_pos, issue_id, case when skip_reason is null then 'keep' else 'skip' end as decision, skip_reason from k where kept < 15""",
    "shuffle_positions": f"""with f as ({fx.LOC_BODY}) select issue_id, file_path, row_number() over (partition by issue_id order by md5('7:' || file_path), file_path) as position from f""",
    "text_search": f"""with {CLASSES_SQL}, {LINED_SQL}, q as (select unnest(['the ', 'ion', 'e.', 'qq']) as query),
        l as (select repo, path, unnest(ls) as t, unnest(range(1, len(ls) + 1)) as line from lined where path like '%.py'),
        h as (select repo, query, path, line, t, row_number() over (partition by repo, query order by string_split(path, '/'), line) as hit from l join q on contains(t, query))
        select repo, query, cast(hit as int) as hit, path, cast(line as int) as line, md5(t) as text_md5 from h where hit <= 20""",
    "ranked_parse": f"""with {ANSWER_SQL} select issue_id, ranked,
        case when issue_id % 4 in (0, 1) then 'json' else 'path_order_fallback' end as parser, cast(valid as int) as valid_ranked_count,
        cast(n - valid as int) as completed_missing_candidates from res""",
    "rank_scores": f"""with {ANSWER_SQL} select issue_id, cast(rank as int) as rank, rank = 1 as top1, rank <= 3 as top3, round(1e0 / rank, 9) as mrr from res""",
    "localization_summary": f"""with {ANSWER_SQL} select condition, count(*) as n, round(avg(cast(rank = 1 as int)), 9) as top1_accuracy,
        round(avg(cast(rank <= 3 as int)), 9) as top3_accuracy, round(avg(1e0 / rank), 9) as mrr, round(avg(rank), 9) as avg_rank from res group by 1""",
    "localization_pending": """select c.condition, o.o_orderkey as issue_id from orders o cross join (select distinct o_orderpriority as condition from orders) c
        where c.condition <> o.o_orderpriority""",
}
ORACLES["localization_window"] = """with r as (select *, row_number() over (order by o_orderdate, o_orderkey) as pos from orders),
    c as (select distinct o_orderpriority as condition from orders)
    select o_orderkey as issue_id, condition from r cross join c where pos between 101 and 300 and condition <> o_orderpriority"""
