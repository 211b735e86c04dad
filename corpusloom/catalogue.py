"""Audit operators applied to whole tables, with the SQL that gives the same rows.

Thresholds are chosen so that the tables have findings.
"""

from __future__ import annotations

from dataclasses import fields
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import trees_of_customers as C
from corpusloom.functions import text as T
from corpusloom.operators import audit as O
from corpusloom.operators import drift as D
from corpusloom.operators import graph as G
from corpusloom.operators.settings import matches
from corpusloom.operators.settings import settings as settings_of_trees
from corpusloom.plans import audit as A
from corpusloom.plans.staging import stage, table
from corpusloom.sources.trees import change_times, folder, read_config

ENTRIES: dict[str, tuple] = {}
HREF = r'href="([^"]+)"'


def _query(sql: str | None):
    def keep(f):
        ENTRIES[f.__name__] = (f, sql)
        return f

    return keep


@_query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS raw, generate_subscripts(string_split(regexp_replace(text, '\n$', ''), chr(10)), 1) AS pos FROM documents WHERE text <> ''),
k AS (SELECT doc_id, pos, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS line FROM l),
c AS (SELECT doc_id, lower(line) AS folded, count(*) AS repeats, arg_min(line, pos) AS line FROM k WHERE length(line) >= 40 GROUP BY ALL HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY repeats DESC, folded) AS rank FROM c)
SELECT doc_id, line, repeats, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5
""")
def repeated_line_top5(spark, d) -> DataFrame:
    return O.repeated_lines(table(spark, d, "documents"), ["doc_id"], 2, content="text")


@_query(r"""
WITH n AS (SELECT CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(regexp_replace(text, '\n$', ''), chr(10))) END AS n FROM documents)
SELECT CASE WHEN n >= 60 THEN 'failure' WHEN n >= 30 THEN 'feature_freeze' WHEN n >= 15 THEN 'warning' ELSE 'ok' END AS tier, count(*) AS n_docs, CAST(max(n) AS INTEGER) AS most FROM n GROUP BY 1
""")
def size_tiers(spark, d) -> DataFrame:
    limits = F.struct(F.lit(15).alias("warning"), F.lit(30).alias("freeze"), F.lit(60).alias("failure"))
    sized = table(spark, d, "documents").select(F.coalesce(F.size(T.lines("text")), F.lit(0)).alias("n"))
    return sized.groupBy(O.tier("n", limits).alias("tier")).agg(F.count("*").alias("n_docs"), F.max("n").alias("most"))


@_query(r"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+') AS w FROM documents),
c AS (SELECT doc_id, len(list_filter(w, lambda x: x = 'the')) + len(list_filter(w, lambda x: x = 'que')) + len(regexp_extract_all(text, '\. ')) AS n FROM w)
SELECT doc_id, CAST(n AS INTEGER) AS placeholders FROM c WHERE n >= 3
""")
def token_density(spark, d) -> DataFrame:
    return O.placeholder_density(table(spark, d, "documents"), ["the", "que", ". ", " "], 3, "text").select("doc_id", "placeholders")


@_query(r"""
WITH r AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS ref FROM pages),
p AS (SELECT string_split(url, '/') AS parts FROM pages), q AS (SELECT parts, unnest(generate_series(1, len(parts))) AS n FROM p)
SELECT page_id, ref FROM r WHERE ref NOT IN (SELECT array_to_string(parts[1:n], '/') FROM q)
""")
def broken_links(spark, d) -> DataFrame:
    pages = table(spark, d, "pages").withColumn("repo", F.lit(""))
    refs = pages.select("repo", "page_id", F.explode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("path"))
    return O.missing_references(refs, pages.select("repo", F.col("url").alias("path")).filter("path is not null")).select("page_id", F.col("path").alias("ref"))


@_query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_documents(spark, d) -> DataFrame:
    listed = table(spark, d, "documents").select(F.lit("").alias("repo"), F.concat(F.lit("documents/"), F.col("doc_id")).alias("path"), "doc_id", "source")
    known = table(spark, d, "labels").select(F.lit("").alias("repo"), F.col("doc_id").cast("string").alias("name"))
    return O.unregistered(listed, listed, known).select("doc_id", "source")


@_query("""
WITH p AS (SELECT *, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS priority FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority, ts, event_id) AS k FROM p)
SELECT user_id, event_id, event_type FROM r WHERE k = 1
""")
def first_by_priority(spark, d) -> DataFrame:
    kind = F.col("event_type")
    priority = F.when(kind == "purchase", 0).when(kind == "signup", 1).when(kind == "click", 2).otherwise(3)
    return O.first_by_priority(table(spark, d, "events"), ["user_id"], [priority, "ts", "event_id"]).select("user_id", "event_id", "event_type")


@_query("""
WITH l AS (SELECT user_id, max(ts) AS value FROM events GROUP BY user_id)
SELECT user_id, CAST(round_even((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(value)) / 86400000000, 0) AS INTEGER) AS age_days FROM l WHERE value < TIMESTAMP '2024-01-30'
""")
def stale_users(spark, d) -> DataFrame:
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("value"))
    return O.stale(last, F.expr("timestamp_ntz '2024-01-31 00:00:00'"), 1).select("user_id", "age_days")


@_query(r"""
WITH r AS (SELECT unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS ref FROM pages)
SELECT DISTINCT list_extract(string_split(ref, '/'), -1) AS name FROM r
""")
def distinct_link_names(spark, d) -> DataFrame:
    refs = table(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("ref"))
    return refs.select(T.name("ref").alias("name")).distinct()


@_query("""
SELECT event_id, '[Events] ' || event_type || ' logged { event_id=' || event_id || '; user_id=' || user_id || ' }' AS line FROM events WHERE event_type = 'error'
""")
def event_log_lines(spark, d) -> DataFrame:
    errors = table(spark, d, "events").filter("event_type = 'error'")
    metadata = F.create_map(F.lit("user_id"), F.col("user_id").cast("string"), F.lit("event_id"), F.col("event_id").cast("string"))
    return errors.select("event_id", T.event_line("Events", "event_type", F.lit("logged"), metadata).alias("line"))


@_query("""
SELECT source AS repo, count(*) FILTER (WHERE toxic = 1) AS errors, count(*) FILTER (WHERE quality = 0) AS warnings, count(*) FILTER (WHERE toxic = 1) AS code_health_findings,
       count(*) FILTER (WHERE quality = 0) AS maintenance_findings, count(*) FILTER (WHERE toxic = 1) = 0 AS ok
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source
""")
def source_summary(spark, d) -> DataFrame:
    files = table(spark, d, "documents").select(F.col("source").alias("repo"), "doc_id")
    met = files.join(table(spark, d, "labels"), "doc_id")
    toxic = met.filter("toxic = 1").select("repo", F.lit("code-health-toxic").alias("check"), F.lit("failed").alias("status"))
    return A.summary(files, toxic.unionByName(met.filter("quality = 0").select("repo", F.lit("maintenance-quality").alias("check"), F.lit("warning").alias("status"))))


# Below: one source tree for every customer (trees_of_customers.py), audited as a whole. The SQL derives what must come out from the customer's key.
T_SQL = "WITH t AS (SELECT c_name AS repo, c_custkey AS k FROM customer)"
REFS_SQL = """
  SELECT repo, k, 'required-reading' AS "check", unnest([concat('docs/w', k % 3, '.md'), 'docs', concat('lost', k % 2, '.md')]) AS path FROM t
  UNION ALL SELECT repo, k, 'docs-core-document', unnest(['docs/TESTING.md', concat('docs/w', k % 4, '.md'), concat('docs/w', k % 4, '.md')]) FROM t WHERE k % 5 <> 0
  UNION ALL SELECT repo, k, 'harness-checklist', unnest(['.harness/checklists/a.md', '.harness/checklists/deep/B.md']) FROM t
  UNION ALL SELECT repo, k, 'harness-prompt', concat('.harness/prompts/p', k % 3, '.md') FROM t
"""
GONE_SQL = "(path IN ('docs/w2.md', 'docs/w3.md', 'lost1.md', '.harness/prompts/p0.md', '.harness/prompts/p2.md') OR path = '.harness/checklists/deep/B.md' AND k % 2 = 1)"
ROWS_SQL = "SELECT repo, k, CAST(i AS INTEGER) AS row_index, (k + i) % 4 AS kind FROM t, generate_series(0, 6) g(i) WHERE i < 5 + k % 3"
CODE_SQL = """
  SELECT repo, k, 'src/big.py' AS path, 3 + k % 12 AS n, 'default_code' AS category, [5, 9, 12] AS lim FROM t
  UNION ALL SELECT repo, k, 'db/schema.sql', 3 + k % 12, 'migration_or_schema', [7, 11, 15] FROM t UNION ALL SELECT repo, k, 'web/page.tsx', 3 + k % 12, 'markup_or_component', [6, 10, 14] FROM t
  UNION ALL SELECT repo, k, 'generated/root.py', 1, 'default_code', [5, 9, 12] FROM t UNION ALL SELECT repo, k, 'src/fun.py', 2 + k % 6, 'default_code', [5, 9, 12] FROM t
  UNION ALL SELECT repo, k, 'src/rep.js', 2 + k % 4, 'default_code', [5, 9, 12] FROM t UNION ALL SELECT repo, k, 'src/gone.py', NULL, 'default_code', [5, 9, 12] FROM t WHERE k % 10 = 0
"""
TIER_SQL = "CASE WHEN n >= lim[3] THEN 'failure' WHEN n >= lim[2] THEN 'feature_freeze' WHEN n >= lim[1] THEN 'warning' ELSE 'ok' END"
LONG_SQL = f"SELECT repo, k, path, n AS lines FROM ({CODE_SQL}) WHERE path IN ('web/page.tsx', 'src/fun.py') AND {TIER_SQL} IN ('ok', 'warning') AND n >= 5"
CHANGED_SQL = """
  SELECT repo, k, CASE WHEN k % 6 = 0 THEN TIMESTAMP '2024-01-31' - (k % 20) * INTERVAL 1 DAY ELSE TIMESTAMP '2024-01-31' - (24 * (k % 30) + 12 * (k % 2)) * INTERVAL 1 HOUR END AS value,
         CASE WHEN k % 6 = 0 THEN 'git_log' ELSE 'fallback_last_write_time' END AS source FROM t WHERE k % 3 = 0
"""
DENSE_SQL = f"SELECT repo, 'docs/w0.md' AS path, 2 + k % 3 AS n FROM t UNION ALL SELECT repo, 'docs/TESTING.md', 1 + count(*) FILTER (WHERE kind = 0) FROM ({ROWS_SQL}) GROUP BY repo"
COMMANDS_SQL = """
  SELECT *, k % 2 = 0 AND k % 14 <> 0 AS node, k % 3 = 1 AS py, k % 5 = 0 AS rust, k % 7 = 0 AS go, CASE WHEN k % 6 = 1 THEN 'uv run' ELSE 'python -m' END AS runner,
         CASE WHEN k % 3 = 0 THEN 'pnpm' WHEN k % 5 = 0 THEN 'yarn' ELSE 'npm' END AS pm, CASE WHEN k % 3 = 0 THEN 'pnpm ' WHEN k % 5 = 0 THEN 'yarn ' ELSE 'npm run ' END AS run FROM t
"""
MERGED_SQL = f"""
  SELECT repo, k, 0 AS place, 'install' AS id, CASE WHEN node THEN pm || ' install' WHEN py AND k % 6 = 1 THEN 'uv sync' WHEN py THEN 'python -m pip install -e .' END AS command,
         CASE WHEN node THEN 'package.json detected' WHEN py AND k % 6 = 1 THEN 'uv.lock detected' WHEN py THEN 'pyproject.toml detected' END AS note FROM ({COMMANDS_SQL})
  UNION ALL SELECT repo, k, 1, 'dev', CASE WHEN node THEN run || 'start' END, CASE WHEN node THEN concat('package script ', chr(39), 'start', chr(39)) END FROM ({COMMANDS_SQL})
  UNION ALL SELECT repo, k, 2, 'test', CASE WHEN py THEN runner || ' pytest' WHEN rust THEN 'cargo test' WHEN go THEN 'go test ./...' END,
         CASE WHEN py THEN 'pytest detected' WHEN rust THEN 'Cargo.toml detected' WHEN go THEN 'go.mod detected' END FROM ({COMMANDS_SQL})
  UNION ALL SELECT repo, k, 3, 'lint', CASE WHEN node THEN run || 'lint' WHEN py THEN runner || ' ruff check .' END, CASE WHEN node THEN concat('package script ', chr(39), 'lint', chr(39)) WHEN py THEN 'ruff detected' END FROM ({COMMANDS_SQL})
  UNION ALL SELECT repo, k, 4, 'typecheck', CASE WHEN node AND k % 4 = 0 THEN run || 'tsc' WHEN rust THEN 'cargo check' END,
         CASE WHEN node AND k % 4 = 0 THEN concat('package script ', chr(39), 'tsc', chr(39)) WHEN rust THEN 'Cargo.toml detected' END FROM ({COMMANDS_SQL})
  UNION ALL SELECT repo, k, 5, 'build', CASE WHEN node AND k % 4 = 0 THEN run || 'build' WHEN rust THEN 'cargo build' WHEN go THEN 'go build ./...' END,
         CASE WHEN node AND k % 4 = 0 THEN concat('package script ', chr(39), 'build', chr(39)) WHEN rust THEN 'Cargo.toml detected' WHEN go THEN 'go.mod detected' END FROM ({COMMANDS_SQL})
"""
#: (repo, check, kind) of all findings but the event of the threshold
FOUND_SQL = f"""
  SELECT repo, "check", 'failure' AS kind FROM ({REFS_SQL}) WHERE {GONE_SQL}
  UNION ALL SELECT repo, 'testing-command-row', 'failure' FROM t WHERE k % 3 = 0 UNION ALL SELECT repo, 'testing-command-row', 'failure' FROM ({ROWS_SQL}) WHERE k % 3 > 0 AND row_index < 6 AND kind >= 2
  UNION ALL SELECT DISTINCT repo, 'testing-todo', 'todo' FROM ({ROWS_SQL}) WHERE kind = 0
  UNION ALL SELECT repo, 'maintenance-unregistered-checklist', 'drift' FROM t WHERE k % 7 = 0 UNION ALL SELECT repo, 'maintenance-unregistered-prompt', 'drift' FROM t WHERE k % 3 <> 1
  UNION ALL SELECT repo, 'maintenance-stale-active-plan', 'drift' FROM ({CHANGED_SQL}) WHERE value < TIMESTAMP '2024-01-17'
  UNION ALL SELECT repo, 'maintenance-generated-todo', 'drift' FROM t WHERE k % 3 < 2
  UNION ALL SELECT repo, 'maintenance-placeholder-density', 'drift' FROM ({DENSE_SQL}) WHERE n >= 3
  UNION ALL SELECT repo, 'maintenance-exec-plan-usage', 'drift' FROM t WHERE k % 3 > 0 AND k % 4 > 0
  UNION ALL SELECT repo, 'code-health-read-file', 'drift' FROM t WHERE k % 10 = 0
  UNION ALL SELECT repo, 'code-health-large-file', CASE WHEN n >= lim[3] THEN 'drift' ELSE 'notice' END FROM ({CODE_SQL}) WHERE n >= lim[1]
  UNION ALL SELECT repo, 'code-health-long-function', 'notice' FROM ({LONG_SQL}) UNION ALL SELECT repo, 'code-health-repeated-line', 'notice' FROM t WHERE k % 4 >= 2
"""
ALL_SQL = f"""
  SELECT * FROM ({FOUND_SQL}) UNION ALL SELECT repo, 'maintenance-finding-threshold', 'drift' FROM ({FOUND_SQL}) WHERE "check" LIKE 'maintenance-%' GROUP BY repo HAVING count(*) >= 5
"""
IN_TEMPLATE, IN_PROJECT = "CASE kind WHEN 'failure' THEN 'failed' ELSE 'warning' END", "CASE WHEN kind IN ('failure', 'drift', 'todo') THEN 'failed' ELSE 'warning' END"


#: settings of every tree: all default, or by its configuration file
PLAIN_SQL = "SELECT repo, k, 14 AS days, 3 AS dense_min, false AS own, true AS usage, 5 AS maint_min, 5 AS warn, 5 AS long_min, 4 AS rep_min, false AS no_src, 'missing' AS state, 'TODO,FIXME,TBD,XXX,???' AS patterns FROM t"
CONFIGURED_SQL = """
  WITH c AS (SELECT c_name AS repo, c_custkey AS k, c_nationkey AS nation, c_mktsegment AS segment, c_custkey % 11 <> 0 AND c_custkey % 7 <> 0 AS read, c_custkey % 5 = 0 AS bad FROM customer)
  SELECT repo, k, CASE WHEN read AND NOT bad THEN nation + 1 ELSE 14 END AS days, CASE WHEN read THEN 1 + k % 4 ELSE 3 END AS dense_min, read AS own, CASE WHEN read AND NOT bad THEN k % 2 = 0 ELSE true END AS usage,
         CASE WHEN read THEN 2 ELSE 5 END AS maint_min, CASE WHEN read THEN 4 + k % 3 ELSE 5 END AS warn, CASE WHEN read THEN 3 + k % 5 ELSE 5 END AS long_min, CASE WHEN read THEN 2 + k % 3 ELSE 4 END AS rep_min, read AND k % 3 = 0 AS no_src,
         CASE WHEN k % 11 = 0 THEN 'missing' WHEN NOT read THEN 'invalid' WHEN bad THEN 'faulty' ELSE 'ok' END AS state, CASE WHEN read THEN 'TODO,' || segment ELSE 'TODO,FIXME,TBD,XXX,???' END AS patterns FROM c
"""


def _lines_sql(settings: str, mode: str = "Project", strict: str = "True") -> str:
    """(repo, check, kind, about): all findings with their metadata as text, with the settings of each tree."""
    run, name = f"mode={mode}", f"strict={strict}"
    code = f"SELECT c.repo, c.k, path, n, category, CASE WHEN category = 'default_code' THEN [warn, 9, 12] ELSE lim END AS lim, long_min, rep_min FROM ({CODE_SQL}) c JOIN s USING (repo) WHERE NOT (no_src AND path LIKE 'src/%')"
    found = f"""
      SELECT repo, "check", 'failure' AS kind, concat('path=', path, '; reason=missing') AS about FROM ({REFS_SQL}) WHERE {GONE_SQL}
      UNION ALL SELECT repo, 'config', 'failure', 'path=.harness/config.json; reason=invalid_json' FROM s WHERE state = 'invalid'
      UNION ALL SELECT repo, 'config', 'failure', unnest(['key=staleActivePlanDays; path=.harness/config.json; reason=invalid_positive_integer; value=0', 'key=requireExecPlanUsage; path=.harness/config.json; reason=invalid_boolean; value=maybe']) FROM s WHERE state = 'faulty'
      UNION ALL SELECT repo, 'testing-command-row', 'failure', 'count=5; expected=6; path=docs/TESTING.md; reason=missing_command_rows' FROM t WHERE k % 3 = 0
      UNION ALL SELECT repo, 'testing-command-row', 'failure', concat('path=docs/TESTING.md; reason=', CASE kind WHEN 2 THEN concat('command_cell_must_be_backticked; rowIndex=', row_index, '; value=run ', row_index) ELSE concat('malformed_command_row; rowIndex=', row_index) END) FROM ({ROWS_SQL}) WHERE k % 3 > 0 AND row_index < 6 AND kind >= 2
      UNION ALL SELECT repo, 'testing-todo', 'drift', concat('count=', count(*), '; {run}; path=docs/TESTING.md; {name}') FROM ({ROWS_SQL}) WHERE kind = 0 GROUP BY repo
      UNION ALL SELECT repo, 'maintenance-unregistered-checklist', 'drift', 'path=.harness/checklists/c.md; reason=not_registered; {name}' FROM t WHERE k % 7 = 0 UNION ALL SELECT repo, 'maintenance-unregistered-prompt', 'drift', 'path=.harness/prompts/p1.md; reason=not_registered; {name}' FROM t WHERE k % 3 <> 1
      UNION ALL SELECT repo, 'maintenance-stale-active-plan', 'drift', concat('days=', CAST(round_even((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(value)) / 86400000000, 0) AS INTEGER), '; path=docs/exec-plans/active/plan.md; source=', source, '; {name}; thresholdDays=', days)
        FROM ({CHANGED_SQL}) JOIN s USING (repo) WHERE value < TIMESTAMP '2024-01-31' - days * INTERVAL 1 DAY
      UNION ALL SELECT repo, 'maintenance-generated-todo', 'drift', 'path=docs/generated/g.md; reason=generated_at_todo; {name}' FROM t WHERE k % 3 < 2
      UNION ALL SELECT repo, 'maintenance-placeholder-density', 'drift', concat('count=', n, '; path=', path, '; patterns=', patterns, '; {name}; threshold=', dense_min) FROM (
        SELECT repo, 'docs/w0.md' AS path, CASE WHEN own THEN 1 ELSE 2 + k % 3 END AS n, dense_min, patterns FROM s UNION ALL SELECT repo, 'docs/generated/g.md', CAST(k % 3 = 0 AS INTEGER), dense_min, patterns FROM s
        UNION ALL SELECT s.repo, 'docs/TESTING.md', 1 + count(*) FILTER (WHERE kind = 0), dense_min, patterns FROM s JOIN ({ROWS_SQL}) USING (repo) GROUP BY ALL) WHERE n >= dense_min
      UNION ALL SELECT repo, 'maintenance-exec-plan-usage', 'drift', 'active=0; completed=0; reason=no_exec_plans_found; {name}' FROM s WHERE k % 3 > 0 AND k % 4 > 0 AND usage
      UNION ALL SELECT repo, 'code-health-read-file', 'drift', '{run}; path=src/gone.py; reason=read_failed; {name}' FROM s WHERE k % 10 = 0 AND NOT no_src
      UNION ALL SELECT repo, 'code-health-large-file', CASE WHEN n >= lim[3] THEN 'drift' ELSE 'notice' END, concat('category=', category, '; lines=', n, '; {run}; path=', path, '; reason=',
        CASE WHEN n >= lim[3] THEN 'file_size_failure_candidate' WHEN n >= lim[2] THEN 'feature_freeze_candidate' ELSE 'large_file_candidate' END, '; {name}; threshold=', CASE WHEN n >= lim[3] THEN lim[3] WHEN n >= lim[2] THEN lim[2] ELSE lim[1] END) FROM ({code}) WHERE n >= lim[1]
      UNION ALL SELECT repo, 'code-health-long-function', 'notice', concat('lines=', n, '; {run}; name=', CASE path WHEN 'src/fun.py' THEN concat('def f', k, '(') ELSE 'function g' END, '; path=', path, '; startLine=1; {name}; threshold=', long_min)
        FROM ({code}) WHERE path IN ('web/page.tsx', 'src/fun.py') AND n < lim[2] AND n >= long_min
      UNION ALL SELECT repo, 'code-health-repeated-line', 'notice', concat('count=', n, '; {run}; path=src/rep.js; sample={C.LINE}; {name}; threshold=', rep_min) FROM ({code}) WHERE path = 'src/rep.js' AND n < lim[2] AND n >= rep_min
    """
    return f"""{T_SQL}, s AS ({settings}), f AS ({found}), a AS (SELECT * FROM f UNION ALL
      SELECT repo, 'maintenance-finding-threshold', 'drift', concat('count=', count(*), '; {run}; {name}; threshold=', maint_min) FROM f JOIN s USING (repo) WHERE "check" LIKE 'maintenance-%' GROUP BY repo, maint_min HAVING count(*) >= maint_min)"""


def _audit(spark, d, **asked) -> tuple[DataFrame, DataFrame]:
    files = stage(C.trees(spark, d), "trees")  # every check reads its own paths of it
    return files, A.audit(files, C.CONFIG, datetime.fromisoformat(C.AS_OF), maintenance=True, code_health=True, commits=C.commits(files), **asked)


@_query(f'{T_SQL} SELECT repo, "check", path FROM ({REFS_SQL}) WHERE {GONE_SQL}')
def missing_references(spark, d) -> DataFrame:
    files = C.trees(spark, d)
    return O.missing_references(A.all_references(files), files).select("repo", "check", "path")


@_query(f'{T_SQL} SELECT repo, "check", path FROM ({REFS_SQL}) WHERE NOT {GONE_SQL}')
def present_references(spark, d) -> DataFrame:
    files = C.trees(spark, d)
    return O.present_references(A.all_references(files), files).select("repo", "check", "path")


@_query(f"{T_SQL} SELECT repo, row_index, CAST(row_index + 6 AS INTEGER) AS line_index, CASE kind WHEN 0 THEN '`TODO`' WHEN 1 THEN concat('`run ', row_index, '`') WHEN 2 THEN concat('run ', row_index) END AS command FROM ({ROWS_SQL})")
def command_rows(spark, d) -> DataFrame:
    return O.command_rows(C.trees(spark, d).filter(F.col("path") == A.COMMANDS)).select("repo", "row_index", "line_index", F.get("cells", F.lit(1)).alias("command"))


@_query(f"""{T_SQL} SELECT repo, CAST(NULL AS INTEGER) AS row_index, 'missing_command_rows' AS reason, '5' AS value FROM t WHERE k % 3 = 0
UNION ALL SELECT repo, row_index, CASE kind WHEN 2 THEN 'command_cell_must_be_backticked' ELSE 'malformed_command_row' END, CASE kind WHEN 2 THEN concat('run ', row_index) END FROM ({ROWS_SQL}) WHERE k % 3 > 0 AND row_index < 6 AND kind >= 2""")
def bad_command_rows(spark, d) -> DataFrame:
    files = C.trees(spark, d).filter(F.col("path") == A.COMMANDS)
    return O.bad_command_rows(files, O.command_rows(files)).select("repo", "row_index", "reason", "value")


@_query(f"{T_SQL} SELECT repo, count(*) AS n FROM ({ROWS_SQL}) WHERE kind = 0 GROUP BY repo")
def todo_commands(spark, d) -> DataFrame:
    return O.todo_rows(O.command_rows(C.trees(spark, d).filter(F.col("path") == A.COMMANDS)))


@_query(f"{T_SQL} SELECT repo, '.harness/checklists/c.md' AS path FROM t WHERE k % 7 = 0 UNION ALL SELECT repo, '.harness/prompts/p1.md' FROM t WHERE k % 3 <> 1")
def unregistered_files(spark, d) -> DataFrame:
    files = C.trees(spark, d)
    found = [O.unregistered(files, folder(files, below), O.registered_names(files, ".harness/README.md", heading)).select("repo", "path") for _, heading, below in A.REGISTERS]
    return reduce(DataFrame.unionByName, found)


@_query(f"{T_SQL} SELECT repo, unnest(['a.md', 'b.md']) AS name FROM t")
def registered_names(spark, d) -> DataFrame:
    return O.registered_names(C.trees(spark, d), ".harness/README.md", "Checklists")


@_query(f"""{T_SQL} SELECT repo, source, CAST(round_even((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(value)) / 86400000000, 0) AS INTEGER) AS age_days FROM ({CHANGED_SQL}) WHERE value < TIMESTAMP '2024-01-17'""")
def stale_plans(spark, d) -> DataFrame:
    files = C.trees(spark, d)
    return O.stale(change_times(folder(files, A.ACTIVE), C.commits(files)), F.to_timestamp(F.lit(C.AS_OF)), 14).select("repo", "source", "age_days")


@_query(f"{T_SQL} SELECT repo, 'docs/generated/g.md' AS path FROM t WHERE k % 3 < 2")
def generated_todo(spark, d) -> DataFrame:
    return O.generated_todo(folder(C.trees(spark, d), A.GENERATED)).select("repo", "path")


@_query(f"{T_SQL} SELECT repo, path, CAST(n AS INTEGER) AS placeholders FROM ({DENSE_SQL}) WHERE n >= 3")
def placeholder_density(spark, d) -> DataFrame:
    return O.placeholder_density(folder(C.trees(spark, d), "", recursive=True), list(C.CONFIG.placeholder_patterns), 3).select("repo", "path", "placeholders")


@_query(f"{T_SQL} SELECT repo, CAST(k % 3 = 0 AS BIGINT) AS active, CAST(k % 4 = 0 AS BIGINT) AS completed FROM t")
def plan_usage(spark, d) -> DataFrame:
    return O.plan_usage(C.trees(spark, d), A.ACTIVE, A.COMPLETED)


@_query(f"{T_SQL} SELECT repo, path FROM ({CODE_SQL})")
def code_candidates(spark, d) -> DataFrame:
    return O.code_files(C.trees(spark, d), C.CONFIG).select("repo", "path")


@_query(f"{T_SQL} SELECT repo, path, CAST(n AS INTEGER) AS n_lines, category, {TIER_SQL} AS tier FROM ({CODE_SQL}) WHERE n IS NOT NULL")
def code_tiers(spark, d) -> DataFrame:
    return O.sized(O.code_files(C.trees(spark, d), C.CONFIG), C.CONFIG).select("repo", "path", "n_lines", F.col("limits.category").alias("category"), "tier")


@_query(f"{T_SQL} SELECT repo, path, CASE path WHEN 'src/fun.py' THEN concat('def f', k, '(') ELSE 'function g' END AS name, 1 AS start_line, CAST(lines AS INTEGER) AS lines FROM ({LONG_SQL})")
def long_functions(spark, d) -> DataFrame:
    sized = O.sized(O.code_files(C.trees(spark, d), C.CONFIG), C.CONFIG)
    return O.long_functions(O.looked_into(sized), C.CONFIG.long_function_lines)


@_query(f"{T_SQL} SELECT repo, 'src/rep.js' AS path, '{C.LINE}' AS line, 2 + k % 4 AS repeats, 1 AS rank FROM t WHERE k % 4 >= 2")
def repeated_code_lines(spark, d) -> DataFrame:
    sized = O.sized(O.code_files(C.trees(spark, d), C.CONFIG), C.CONFIG)
    return O.repeated_lines(O.looked_into(sized), O.KEY, C.CONFIG.repeated_line_threshold)


@_query(f"{T_SQL} SELECT repo, id, coalesce(command, 'TODO') AS command, coalesce(note, 'no command detected') AS note FROM ({MERGED_SQL})")
def merged_commands(spark, d) -> DataFrame:
    return O.merged_commands(C.trees(spark, d)).select("repo", "id", "command", "note")


@_query(f"""{T_SQL} SELECT repo, CAST(6 + place AS INTEGER) AS line_index, concat('| c', place, ' | `', coalesce(command, 'TODO'), '` | ', coalesce(note, 'no command detected'), ' |') AS proposed FROM ({MERGED_SQL}) WHERE k % 3 > 0""")
def proposed_rows(spark, d) -> DataFrame:
    return O.proposed_rows(C.trees(spark, d), A.COMMANDS).select("repo", "line_index", "proposed")


@_query(f"""{T_SQL}, r AS (SELECT repo, k, string_agg(concat('| c', place, ' | `', coalesce(command, 'TODO'), '` | ', coalesce(note, 'no command detected'), ' |' || chr(10)), '' ORDER BY place) AS rows FROM ({MERGED_SQL}) WHERE k % 3 > 0 GROUP BY ALL),
s AS (SELECT repo, k, rows || CASE WHEN k % 3 = 2 THEN CASE (k + 6) % 4 WHEN 0 THEN '| c6 | `TODO` | n |' WHEN 1 THEN '| c6 | `run 6` | n |' WHEN 2 THEN '| c6 | run 6 | n |' ELSE '| c6 |' END || chr(10) ELSE '' END AS rows FROM r)
SELECT repo, replace('# T@@## commands@@| Purpose | Command | Note |@|---|---|---|@', '@', chr(10)) || rows || replace('@## Other@| z | `TODO` | n |@', '@', chr(10)) AS content FROM s""")
def applied_commands(spark, d) -> DataFrame:
    return O.applied_commands(C.trees(spark, d), A.COMMANDS).select("repo", "content")


@_query(f"""{T_SQL} SELECT repo, concat('[TestingBootstrap] ', CASE WHEN command IS NULL THEN 'not_detected' ELSE 'detected' END, ' {{ command=', coalesce(command, 'TODO'), '; id=', id, '; note=', coalesce(note, 'no command detected'), ' }}') AS line FROM ({MERGED_SQL})
UNION ALL SELECT repo, '[TestingBootstrap] warning {{ path=package.json; reason=invalid_json }}' FROM t WHERE k % 14 = 0 UNION ALL SELECT repo, '[TestingBootstrap] dry_run {{ apply=use apply to update docs/TESTING.md }}' FROM t""")
def command_log(spark, d) -> DataFrame:
    return A.bootstrap_lines(A.command_events(C.trees(spark, d)))


@_query(f"""{T_SQL}, f AS (SELECT repo, "check", {IN_TEMPLATE} AS status FROM ({ALL_SQL})) SELECT repo, "check", status, count(*) AS n FROM f GROUP BY ALL""")
def audit_in_template_mode(spark, d) -> DataFrame:
    return _audit(spark, d)[1].groupBy("repo", "check", "status").agg(F.count("*").alias("n"))


@_query(f"""{T_SQL}, f AS (SELECT repo, "check", {IN_PROJECT} AS status FROM ({ALL_SQL})) SELECT repo, "check", status, count(*) AS n FROM f GROUP BY ALL""")
def audit_in_strict_mode(spark, d) -> DataFrame:
    return _audit(spark, d, strict=True)[1].groupBy("repo", "check", "status").agg(F.count("*").alias("n"))


@_query(f"""{T_SQL}, f AS (SELECT repo, CASE kind WHEN 'failure' THEN 'failed' ELSE 'warning' END AS status FROM ({FOUND_SQL}) WHERE "check" NOT LIKE 'maintenance-%') SELECT repo, status, count(*) AS n FROM f WHERE repo IS NOT NULL GROUP BY ALL""")
def audit_of_code_only(spark, d) -> DataFrame:
    found = A.audit(stage(C.trees(spark, d), "trees"), C.CONFIG, code_health=True)
    return found.groupBy("repo", "status").agg(F.count("*").alias("n"))


@_query(f"""{T_SQL}, f AS (SELECT repo, "check", {IN_PROJECT} AS status FROM ({ALL_SQL}))
SELECT repo, count(*) FILTER (WHERE status = 'failed') AS errors, count(*) FILTER (WHERE status = 'warning') AS warnings, count(*) FILTER (WHERE "check" LIKE 'maintenance-%' AND "check" <> 'maintenance-finding-threshold') AS maintenance_findings,
       count(*) FILTER (WHERE "check" LIKE 'code-health-%') AS code_health_findings, count(*) FILTER (WHERE status = 'failed') = 0 AS ok FROM t LEFT JOIN f USING (repo) GROUP BY repo""")
def audit_summary(spark, d) -> DataFrame:
    return A.summary(*_audit(spark, d, project=True))


@_query(f"""{T_SQL}, f AS (SELECT repo, "check", {IN_TEMPLATE} AS status FROM ({ALL_SQL})), o AS (
  SELECT repo, k, count(*) FILTER (WHERE status = 'failed') AS errors, count(*) FILTER (WHERE status = 'warning') AS warnings, count(*) FILTER (WHERE "check" LIKE 'maintenance-%' AND "check" <> 'maintenance-finding-threshold') AS m,
         count(*) FILTER (WHERE "check" LIKE 'code-health-%') AS c, count(*) FILTER (WHERE "check" = 'maintenance-stale-active-plan') AS stale, count(*) FILTER (WHERE "check" = 'maintenance-placeholder-density') AS dense,
         count(*) FILTER (WHERE "check" = 'testing-todo') AS todo FROM t LEFT JOIN f USING (repo) GROUP BY ALL), refs AS ({REFS_SQL})
SELECT repo, '[Audit] validation start {{ codeHealth=True; effectiveMode=Template; maintenance=True; mode=Template; strict=False }}' AS line FROM t
UNION ALL SELECT repo, '[Audit] config warning {{ path=.harness/config.json; reason=missing_using_defaults }}' FROM t
UNION ALL SELECT repo, concat('[Audit] ', "check", ' success {{ path=', path, ' }}') FROM refs WHERE NOT {GONE_SQL}
UNION ALL SELECT repo, concat('[Audit] required-reading-summary success {{ count=3 }}') FROM t UNION ALL SELECT repo, concat('[Audit] docs-core-document-summary success {{ count=', CASE WHEN k % 5 = 0 THEN 0 ELSE 3 END, ' }}') FROM t
UNION ALL SELECT repo, '[Audit] harness-checklist-summary success {{ count=2 }}' FROM t UNION ALL SELECT repo, '[Audit] harness-prompt-summary success {{ count=1 }}' FROM t
UNION ALL SELECT repo, '[Audit] testing-todo success {{ count=0; mode=Template; strict=False }}' FROM o WHERE todo = 0
UNION ALL SELECT repo, '[Audit] maintenance start {{ mode=Template; strict=False }}' FROM t
UNION ALL SELECT repo, '[Audit] maintenance-unregistered-checklist success {{ count=2 }}' FROM t WHERE k % 7 <> 0 UNION ALL SELECT repo, '[Audit] maintenance-unregistered-prompt success {{ count=1 }}' FROM t WHERE k % 3 = 1
UNION ALL SELECT repo, concat('[Audit] maintenance-stale-active-plan success {{ count=', CAST(k % 3 = 0 AS INTEGER), '; thresholdDays=14 }}') FROM o WHERE stale = 0
UNION ALL SELECT repo, '[Audit] maintenance-generated-todo success {{ count=1 }}' FROM t WHERE k % 3 = 2
UNION ALL SELECT repo, concat('[Audit] maintenance-placeholder-density success {{ scanned=', 11 + CAST(k % 7 = 0 AS INTEGER) + CAST(k % 2 = 0 AS INTEGER) + CAST(k % 3 = 0 AS INTEGER) + CAST(k % 4 = 0 AS INTEGER), '; threshold=3 }}') FROM o WHERE dense = 0
UNION ALL SELECT repo, concat('[Audit] maintenance-exec-plan-usage success {{ active=', CAST(k % 3 = 0 AS INTEGER), '; completed=', CAST(k % 4 = 0 AS INTEGER), ' }}') FROM t WHERE k % 3 = 0 OR k % 4 = 0
UNION ALL SELECT repo, concat('[Audit] maintenance complete {{ findings=', m, ' }}') FROM o
UNION ALL SELECT repo, '[Audit] code-health start {{ failureThreshold=12; featureFreezeThreshold=9; mode=Template; strict=False; warningThreshold=5 }}' FROM t
UNION ALL SELECT repo, concat('[Audit] code-health-large-file success {{ failureThreshold=12; featureFreezeThreshold=9; scanned=', 6 + CAST(k % 10 = 0 AS INTEGER), '; warningThreshold=5 }}') FROM o WHERE c = 0
UNION ALL SELECT repo, concat('[Audit] code-health complete {{ findings=', c, '; scanned=', 6 + CAST(k % 10 = 0 AS INTEGER), ' }}') FROM o
UNION ALL SELECT repo, concat('[Audit] validation ', CASE WHEN errors = 0 THEN 'success' ELSE 'failed' END, ' {{ effectiveMode=Template; errors=', errors, '; warnings=', warnings, ' }}') FROM o""")
def audit_events(spark, d) -> DataFrame:
    files, found = _audit(spark, d)
    return A.log_lines(A.events(files, stage(found, "audit-findings"), C.CONFIG, maintenance=True, code_health=True))


@_query(f"""{_lines_sql(PLAIN_SQL)} SELECT repo, concat('[Audit] ', "check", ' ', {IN_PROJECT}, ' {{ ', about, ' }}') AS line FROM a""")
def finding_lines(spark, d) -> DataFrame:
    """All findings with all that they say."""
    return A.log_lines(_audit(spark, d, strict=True)[1])


def _configured(spark, d, **asked) -> tuple[DataFrame, DataFrame]:
    files = stage(C.configured(spark, d), "trees")
    return files, A.audit(files, C.CONFIG, datetime.fromisoformat(C.AS_OF), maintenance=True, code_health=True, commits=C.commits(files), **asked)


@_query(f"""{_lines_sql(CONFIGURED_SQL)} SELECT repo, concat('[Audit] ', "check", ' ', {IN_PROJECT}, ' {{ ', about, ' }}') AS line FROM a""")
def finding_lines_by_settings(spark, d) -> DataFrame:
    """The same with every tree measured by its own configuration file, and what is wrong with these files."""
    return A.log_lines(_configured(spark, d, strict=True)[1])


@_query(f"""{_lines_sql(CONFIGURED_SQL, "Template", "False")}, b AS (SELECT repo, "check", {IN_TEMPLATE} AS status FROM a)
SELECT repo, count(*) FILTER (WHERE status = 'failed') AS errors, count(*) FILTER (WHERE status = 'warning') AS warnings, count(*) FILTER (WHERE "check" LIKE 'maintenance-%' AND "check" <> 'maintenance-finding-threshold') AS maintenance_findings,
       count(*) FILTER (WHERE "check" LIKE 'code-health-%') AS code_health_findings, count(*) FILTER (WHERE status = 'failed') = 0 AS ok FROM t LEFT JOIN b USING (repo) GROUP BY repo""")
def audit_summary_by_settings(spark, d) -> DataFrame:
    return A.summary(*_configured(spark, d))


@_query(f"""WITH t AS (SELECT 1), s AS ({CONFIGURED_SQL}) SELECT repo, state, CAST(days AS INTEGER) AS days, CAST(dense_min AS INTEGER) AS placeholders, patterns, usage, CAST(warn AS INTEGER) AS warning_lines, CAST(long_min AS INTEGER) AS long_function_lines,
  CASE WHEN no_src THEN 'vendor,/src/' ELSE '.git,docs,.harness,vendor,dist,build,coverage,node_modules' END AS excluded, CASE WHEN no_src THEN 'vendor,src' ELSE '.git,docs,.harness,vendor,dist,build,coverage,node_modules' END AS prefixes,
  CASE state WHEN 'faulty' THEN 2 WHEN 'invalid' THEN 1 ELSE 0 END AS n_findings FROM s""")
def tree_settings(spark, d) -> DataFrame:
    """The settings of every tree."""
    own = lambda c: F.col(f"settings.{c}")
    return settings_of_trees(C.configured(spark, d), C.CONFIG).select(
        "repo", "state", own("stale_active_plan_days").alias("days"), own("placeholder_todo_threshold").alias("placeholders"), F.array_join(own("placeholder_patterns"), ",").alias("patterns"), own("require_exec_plan_usage").alias("usage"),
        "settings.warning_lines", "settings.long_function_lines", F.array_join(own("excluded_paths"), ",").alias("excluded"), F.array_join(own("prefixes"), ",").alias("prefixes"), F.size("found").alias("n_findings"),
    )


@_query(f"""{T_SQL}, f AS (SELECT repo, CASE WHEN kind IN ('failure', 'drift') THEN 'failed' ELSE 'warning' END AS status FROM ({FOUND_SQL}) WHERE "check" NOT LIKE 'maintenance-%') SELECT repo, status, count(*) AS n FROM f GROUP BY ALL""")
def audit_of_code_in_project(spark, d) -> DataFrame:
    """Code only, in project mode: TODOs among the commands stay warnings."""
    found = A.audit(stage(C.trees(spark, d), "trees"), C.CONFIG, code_health=True, project=True)
    return found.groupBy("repo", "status").agg(F.count("*").alias("n"))


@_query(f"""{T_SQL} SELECT repo, CASE WHEN k % 3 = 0 THEN '[TestingBootstrap] failed {{ count=5; expected=6; path=docs/TESTING.md; reason=missing_command_rows }}' ELSE '[TestingBootstrap] applied {{ path=docs/TESTING.md }}' END AS line FROM t""")
def applied_log(spark, d) -> DataFrame:
    """What came of writing the commands into each tree's table."""
    return A.bootstrap_lines(A.command_events(C.trees(spark, d), apply=True).filter(F.col("status").isin("applied", "failed")))


@_query(f"""{T_SQL} SELECT repo, unnest(['.harness/checklists/b.md', 'docs/generated/g.md']) AS path FROM t UNION ALL SELECT repo, '.harness/checklists/c.md' FROM t WHERE k % 7 = 0 UNION ALL SELECT repo, '.harness/prompts/p1.md' FROM t WHERE k % 3 <> 1
UNION ALL SELECT repo, 'lost0.md' FROM t WHERE k % 2 = 1 UNION ALL SELECT repo, 'docs/w0.md' FROM t WHERE NOT (k % 3 = 0 OR k % 5 <> 0 AND k % 4 = 0) UNION ALL SELECT repo, 'docs/w1.md' FROM t WHERE NOT (k % 3 = 1 OR k % 5 <> 0 AND k % 4 = 1)
UNION ALL SELECT repo, 'docs/TESTING.md' FROM t WHERE k % 5 = 0 UNION ALL SELECT repo, 'docs/exec-plans/active/plan.md' FROM t WHERE k % 3 = 0 UNION ALL SELECT repo, 'docs/exec-plans/completed/done.md' FROM t WHERE k % 4 = 0""")
def unused_documents(spark, d) -> DataFrame:
    return D.unused_documents(stage(C.trees(spark, d), "trees"))


@_query(f"""{T_SQL} SELECT repo, unnest(['src/fun.py', 'web/page.tsx']) AS path, unnest([concat('f', k), 'g']) AS name FROM t""")
def unused_functions(spark, d) -> DataFrame:
    return D.unused_functions(stage(C.trees(spark, d), "trees"))


def _orders(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("node"), "o_totalprice", "o_orderpriority", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("next"), F.lead("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("next_price"))


@_query("""
WITH RECURSIVE o AS (SELECT o_custkey AS repo, o_orderkey AS node, o_totalprice AS price, o_orderpriority AS priority, lead(o_orderkey) OVER w AS next, lead(o_totalprice) OVER w AS next_price FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
e AS (SELECT repo, node AS source, next AS target FROM o WHERE next_price > price / 2), r AS (SELECT repo, node FROM o WHERE priority LIKE '1%' UNION SELECT e.repo, e.target FROM r JOIN e ON e.repo = r.repo AND e.source = r.node)
SELECT repo, node FROM r
""")
def reached_orders(spark, d) -> DataFrame:
    """Orders that follow on an urgent one, each worth more than half of the one before."""
    orders = _orders(spark, d)
    edges = orders.filter("next_price > o_totalprice / 2").select("repo", F.col("node").alias("source"), F.col("next").alias("target"))
    return G.reached(edges, orders.filter("o_orderpriority like '1%'").select("repo", "node"))


TRADE_SQL = """
  WITH n AS (SELECT c_nationkey AS source, s_nationkey AS target, max(l_extendedprice) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
  SELECT source, target FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, target) AS k FROM n) WHERE k = 1 OR k = 2 AND source % 2 = 0
"""


def _trade(spark, d) -> DataFrame:
    """(repo, source, target): from each nation to those where it made its dearest purchases."""
    t = lambda name: table(spark, d, name)
    bought = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    most = bought.groupBy(F.col("c_nationkey").alias("source"), F.col("s_nationkey").alias("target")).agg(F.max("l_extendedprice").alias("n"))
    ranked = most.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "target")))
    return ranked.filter("k = 1 or k = 2 and source % 2 = 0").select(F.lit("").alias("repo"), "source", "target")


@_query(f"""WITH RECURSIVE e AS ({TRADE_SQL}), r AS (SELECT source, target FROM e UNION SELECT r.source, e.target FROM r JOIN e ON e.source = r.target)
SELECT a.source AS node, min(b.target) AS cycle FROM r a JOIN r b ON a.source = b.source AND a.target = a.source JOIN r c ON c.source = b.target AND c.target = b.source GROUP BY a.source""")
def trade_cycles(spark, d) -> DataFrame:
    """Nations that buy from each other in a circle."""
    return G.cycles(_trade(spark, d)).select("node", "cycle")


@_query(f"""WITH e AS ({TRADE_SQL}), r AS (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT source, target, a.r_name AS source_layer, b.r_name AS target_layer FROM e JOIN r a ON source = a.n_nationkey JOIN r b ON target = b.n_nationkey
WHERE a.r_name <> b.r_name AND (a.r_name, b.r_name) NOT IN (('ASIA', 'EUROPE'), ('AFRICA', 'EUROPE'), ('AMERICA', 'ASIA'))""")
def trade_against_direction(spark, d) -> DataFrame:
    """The same trade where it leads from one region to another that it is not meant to lead to."""
    regions = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    of = lambda end: regions.select(F.col("n_nationkey").alias(end), F.col("r_name").alias(f"{end}_layer"))
    edges = _trade(spark, d).join(of("source"), "source").join(of("target"), "target")
    return D.layer_violations(edges, (("ASIA", "EUROPE"), ("AFRICA", "EUROPE"), ("AMERICA", "ASIA"))).select("source", "target", "source_layer", "target_layer")


@_query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), p AS (SELECT unnest(['License', 'licensed', 'MIT', '4.0', 'the', 'que']) AS pattern),
c AS (SELECT DISTINCT doc_id, pattern, lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS context FROM l, p
  WHERE CASE WHEN pattern = '4.0' THEN contains(line, '4.0') ELSE list_contains(regexp_extract_all(line, '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+'), pattern) END)
SELECT pattern, context, count(*) AS n_texts, min(doc_id) AS first_doc FROM c GROUP BY pattern, context HAVING count(*) >= 2
""")
def shared_placeholders(spark, d) -> DataFrame:
    found = D.shared_placeholders(table(spark, d, "documents"), ["doc_id"], ["License", "licensed", "MIT", "4.0", "the", "que"], 2, "text")
    return found.select("pattern", "context", "n_texts", F.col("first.doc_id").alias("first_doc"))


PATTERNS = "concat('*/', left(list_extract(string_split(url, '/'), 4), 2), '/', left(coalesce(list_extract(string_split(url, '/'), 5), ''), 1), '*')"


@_query(f"""
WITH u AS (SELECT page_id, url, list_extract(string_split(url, '/'), 3) AS host FROM pages),
p AS (SELECT host, {PATTERNS} AS pattern FROM u WHERE page_id % 3 = 0 UNION SELECT host, concat('*', right(url, 3)) FROM u WHERE page_id % 5 = 0 UNION SELECT host, concat('*?page=', '[0-', page_id % 9, ']*') FROM u WHERE page_id % 7 = 0 UNION SELECT host, concat('*//', host, '/*') FROM u WHERE page_id % 11 = 0)
SELECT page_id, pattern FROM u JOIN p USING (host) WHERE lower(url) GLOB lower(pattern)
""")
def patterns_of_hosts(spark, d) -> DataFrame:
    """Pages with the wildcards of their host that fit their address; every host has its own, taken from some of its pages."""
    u = table(spark, d, "pages").select("page_id", "url", F.get(F.split("url", "/"), F.lit(2)).alias("host"))
    part = lambda i: F.coalesce(F.get(F.split("url", "/"), F.lit(i)), F.lit(""))
    of = lambda n, pattern: u.filter(F.col("page_id") % n == 0).select("host", pattern.alias("pattern"))
    own = of(3, F.concat(F.lit("*/"), F.substring(part(3), 1, 2), F.lit("/"), F.substring(part(4), 1, 1), F.lit("*")))
    more = of(5, F.concat(F.lit("*"), F.right("url", F.lit(3)))).union(of(7, F.concat(F.lit("*?page=[0-"), F.col("page_id") % 9, F.lit("]*")))).union(of(11, F.concat(F.lit("*//"), "host", F.lit("/*"))))
    return matches(u, own.union(more), ["host"], "url").select("page_id", "pattern")


@_query("""
SELECT * FROM (VALUES ('maintenance_finding_threshold', '5'), ('stale_active_plan_days', '7'), ('placeholder_todo_threshold', '3'), ('placeholder_patterns', 'A,B'), ('require_exec_plan_usage', 'False'),
 ('warning_lines', '9'), ('feature_freeze_lines', '800'), ('failure_lines', '1200'), ('markup_warning_lines', '800'), ('markup_feature_freeze_lines', '1200'), ('markup_failure_lines', '1800'),
 ('migration_warning_lines', '1200'), ('migration_feature_freeze_lines', '1800'), ('migration_failure_lines', '2400'), ('long_function_lines', '120'), ('repeated_line_threshold', '6'),
 ('excluded_paths', 'x'), ('excluded_patterns', '**/generated/**,**/vendor/**,**/*.lock,**/*.generated.*,**/migrations/**'),
 ('finding', 'placeholder_todo_threshold invalid_positive_integer'), ('finding', 'failure_lines invalid_positive_integer')) v("key", value)
""")
def settings(spark, d) -> DataFrame:
    text = '{"validation": {"staleActivePlanDays": "7", "placeholderTodoThreshold": 0, "requireExecPlanUsage": "FALSE", "placeholderPatterns": ["A", " ", "B"], "codeHealth": {"warningLines": 9, "failureLines": "5.0", "excludedPaths": ["x", ""]}}}'
    config, found = read_config(spark, text)
    rows = [(f.name, ",".join(v) if isinstance(v := getattr(config, f.name), tuple) else str(v)) for f in fields(config)]
    bad = found.select(F.lit("finding").alias("key"), F.concat_ws(" ", "metadata.key", "metadata.reason").alias("value"))
    return spark.createDataFrame(rows, "key string, value string").unionByName(bad)


@_query(r"""
SELECT page_id, list_extract(string_split(url, '/'), -1) AS name, lower(regexp_extract(list_extract(string_split(url, '/'), -1), '(\.[^.]*)$', 1)) AS extension, regexp_matches(url, '(?is)^.*/[ab].*$') AS fits,
       coalesce(regexp_replace(html, '\s', '', 'g'), '') = '' AS blank, length(trim(regexp_replace(html, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))) AS squeezed, substring(html, 1, 80) AS head FROM pages
""")
def page_texts(spark, d) -> DataFrame:
    return table(spark, d, "pages").select(
        "page_id", T.name("url").alias("name"), T.extension("url").alias("extension"), F.col("url").rlike(T.wildcard("*/[ab]*")).alias("fits"), T.blank("html").alias("blank"),
        F.length(T.squeeze("html")).cast("long").alias("squeezed"), F.substring("html", 1, 80).alias("head"),
    )


def queries():
    return {name: f for name, (f, _) in ENTRIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in ENTRIES.items() if sql}
