"""Work graphs, equivalence classes, target groups and path keys."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from ledgerloom import model as M


def proposal_graph(specs: DataFrame) -> DataFrame:
    """Verdict of each plan's work graph: duplicate_work, unknown_dependency, cyclic_dependency or valid.

    ``specs`` has plan_digest, position, work_id and dependencies.  Duplicates and closure are set
    operations; a plan (at most 1 MiB) is peeled for cycles in one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, verdict = list(pdf["work_id"]), "valid"
        known = set(ids)
        left = {w: set(d if d is not None else ()) for w, d in zip(ids, pdf["dependencies"], strict=True)}
        if len(known) != len(ids):
            verdict = "duplicate_work"
        elif any(not d <= known for d in left.values()):
            verdict = "unknown_dependency"
        else:
            users: dict[str, list[str]] = {w: [] for w in left}
            for w, d in left.items():
                for x in d:
                    users[x].append(w)
            waiting = {w: len(d) for w, d in left.items()}
            free = [w for w, n in waiting.items() if not n]
            done = 0
            while free:
                done += 1
                for u in users[free.pop()]:
                    waiting[u] -= 1
                    if not waiting[u]:
                        free.append(u)
            if done < len(left):
                verdict = "cyclic_dependency"
        return pd.DataFrame({"plan_digest": [pdf["plan_digest"].iloc[0]], "verdict": [verdict]})

    return specs.select("plan_digest", "work_id", "dependencies").groupBy("plan_digest").applyInPandas(run, "plan_digest string, verdict string")


def proposal_gate(proposals: DataFrame, scopes: DataFrame, log: DataFrame, graphs: DataFrame) -> DataFrame:
    """First failing rule of each proposal (scope_id, plan_digest, objective_digest, parent_plan_digest, reserved_budget_units, bases as array<struct<kind, digest, sequence>>): header, bases in order, graph, budget, size, own address.

    With the column ``stored_bytes``, a plan of more than PLAN_BYTES is plan_too_large.  ``log`` holds the facts that
    bases cite; with the column ``fact_scope_id``, the scope that a fact handed over for scope_id really is of, a fact
    of another scope is cross_scope_basis.
    """
    s = scopes.select("scope_id", *(F.col(c).alias(f"own_{c}") for c in ("objective_digest", "active_plan_digest", "sequence")))
    j = proposals.join(s, "scope_id", "left")
    basis = j.select("plan_digest", "scope_id", "own_active_plan_digest", "own_sequence", F.posexplode_outer("bases").alias("i", "b"))
    fact_scope = F.col("fact_scope_id") if "fact_scope_id" in log.columns else F.col("scope_id")
    facts = log.select("scope_id", F.col("sequence").alias("at"), F.col("digest").alias("fact_digest"), "payload_type", (fact_scope == F.col("scope_id")).alias("own_fact"))
    b = basis.join(facts, (basis["scope_id"] == facts["scope_id"]) & (F.col("b.kind") == "observation") & (F.col("b.sequence") == F.col("at")), "left").drop(facts["scope_id"])
    fault = (
        F.when(F.col("b").isNull(), F.lit(None)).when(F.col("b.kind") == "prior_revision", F.when(~F.col("b.digest").eqNullSafe(F.col("own_active_plan_digest")), "stale_basis"))
        .when((F.col("b.sequence") > F.col("own_sequence")) | F.col("at").isNull(), "missing_basis").when(~F.coalesce("own_fact", F.lit(False)), "cross_scope_basis").when(F.col("fact_digest") != F.col("b.digest"), "stale_basis").when(F.col("payload_type") != "root_genesis", "unsupported_planning_input")
    )
    first = b.withColumn("fault", fault).groupBy("plan_digest").agg(F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("i"))).alias("basis_fault"))
    k = j.join(first, "plan_digest", "left").join(graphs.select("plan_digest", F.col("verdict").alias("graph")), "plan_digest", "left")
    cyclic = (F.col("parent_plan_digest") == F.col("plan_digest")) | F.exists("bases", lambda x: (x["kind"] == "prior_revision") & (x["digest"] == F.col("plan_digest")))
    too_large = F.coalesce(F.col("stored_bytes") > M.PLAN_BYTES, F.lit(False)) if "stored_bytes" in proposals.columns else F.lit(False)
    verdict = (
        F.when(F.col("own_sequence").isNull(), "scope_mismatch").when(F.col("objective_digest") != F.col("own_objective_digest"), "objective_mismatch").when(~F.col("parent_plan_digest").eqNullSafe(F.col("own_active_plan_digest")), "stale_basis")
        .when(F.col("basis_fault").isNotNull(), F.col("basis_fault")).when(F.col("graph") != "valid", F.col("graph")).when(F.col("reserved_budget_units") > M.MAX_INTEGER, "budget_out_of_range").when(too_large, "plan_too_large").when(F.coalesce(cyclic, F.lit(False)), "cyclic_basis").otherwise("admissible")
    )
    return k.select("plan_digest", "scope_id", verdict.alias("verdict"))


def edge_closure(deps: DataFrame, work: DataFrame) -> DataFrame:
    """Edges whose target revision isn't admitted."""
    target = work.select("scope_id", F.col("work_id").alias("depends_on_work_id"), F.col("work_revision").alias("depends_on_work_revision"))
    return deps.join(target, ["scope_id", "depends_on_work_id", "depends_on_work_revision"], "left_anti").select("scope_id", "work_id", "depends_on_work_id")


def target_groups(targets: DataFrame, size: int = M.GROUP_TARGETS) -> DataFrame:
    """Groups of at most ``size`` targets of one path, in line and column order."""
    w = Window.partitionBy("path").orderBy("line", "col")
    g = targets.select("path", F.floor((F.row_number().over(w) - 1) / size).cast("long").alias("group_no"))
    return g.groupBy("path", "group_no").agg(F.count("*").alias("targets"))


def equivalence_classes(conclusions: DataFrame, judged: DataFrame) -> DataFrame:
    """Greedy classes by first member, in emission order; of each class the narrowest citation stays.

    ``conclusions`` has run_seq, emission and span; ``judged`` the equivalent (run_seq, a, b) with a the
    class's first member.  Membership depends on the classes before, so a run's conclusions are folded
    as one ordered array; runs spread over tasks.
    """
    pairs = judged.groupBy("run_seq").agg(F.collect_set(F.struct("a", "b")).alias("pairs"))
    queue = conclusions.groupBy("run_seq").agg(F.array_sort(F.collect_list(F.struct("emission", "span"))).alias("queue")).join(pairs, "run_seq", "left")
    queue = queue.withColumn("pairs", F.coalesce("pairs", F.array().cast("array<struct<a:bigint,b:bigint>>")))

    def step(s, x):
        same = F.transform(s["firsts"], lambda f: F.array_contains("pairs", F.struct(f.alias("a"), x["emission"].alias("b"))))
        at = F.array_position(same, True)
        new = at == 0
        return F.struct(F.when(new, F.concat(s["firsts"], F.array(x["emission"]))).otherwise(s["firsts"]).alias("firsts"), F.concat(s["classes"], F.array(F.when(new, F.size(s["firsts"]).cast("long")).otherwise(at - 1))).alias("classes"))

    none = F.array().cast("array<bigint>")
    judged_rows = queue.select("run_seq", F.explode(F.arrays_zip(F.col("queue").alias("q"), F.aggregate("queue", F.struct(none.alias("firsts"), none.alias("classes")), step, lambda s: s["classes"]).alias("c"))).alias("z"))
    rows = judged_rows.select("run_seq", F.col("z.q.emission").alias("emission"), F.col("z.c").alias("class_no"), F.col("z.q.span").alias("span"))
    best = Window.partitionBy("run_seq", "class_no").orderBy("span", "emission")
    return rows.select("run_seq", "emission", "class_no", (F.row_number().over(best) == 1).alias("kept"))


PATH_BYTES, PATH_DEPTH = 180, 10


def path_key(raw: bytes) -> str:
    """Collision key of a path, or REJECT: and the first rule it breaks."""
    try:
        path = raw.decode("utf-8")
    except UnicodeDecodeError:
        return "REJECT:invalid-utf8"
    if len(raw) > PATH_BYTES:
        return "REJECT:path-too-long"
    parts = path.split("/")
    if len(parts) > PATH_DEPTH:
        return "REJECT:path-too-deep"
    for rule, bad in (
        ("empty-component", lambda p: not p), ("dot-component", lambda p: p in (".", "..")), ("git-component", lambda p: p.casefold() == ".git"),
        ("control-char", lambda p: any(c < " " or c == "\x7f" for c in p)), ("forbidden-char", lambda p: '"' in p or "\\" in p),
    ):
        if any(map(bad, parts)):
            return f"REJECT:{rule}"
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", path).casefold())


@F.pandas_udf(StringType())
def _path_keys(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: None if x is None else path_key(bytes(x)))


def path_collisions(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Keys that several different accepted paths share.  Normal forms and case folding have no built-in, so keys come from a vectorised function."""
    keyed = paths.select(F.col(path_col).cast("binary").alias("raw")).distinct().withColumn("key", _path_keys("raw"))
    return keyed.filter(~F.col("key").startswith("REJECT:")).groupBy("key").agg(F.count("*").alias("paths")).filter("paths > 1")


def text_matches(docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every line and column (both from 1) at which a pattern matches in the texts."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("n", "text")).filter(F.rlike("text", F.lit(pattern)))
    hits = F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda h: F.char_length(h))
    gaps = F.transform(F.split("text", pattern, -1), lambda g: F.char_length(g))
    both = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("g"), h.alias("h")))
    found = F.aggregate(both, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("cols")), lambda a, x: F.struct((a["at"] + x["g"] + x["h"]).alias("at"), F.concat(a["cols"], F.array(a["at"] + x["g"] + 1)).alias("cols")), lambda a: a["cols"])
    each = lines.select("id", "n", F.explode(found).alias("col"))
    return each.select(F.col("id").alias(id_col), (F.col("n") + 1).cast("long").alias("line"), F.col("col").cast("long").alias("col"))
