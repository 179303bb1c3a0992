"""Offline measures over capture records.  Money is exact decimal; rates state their zero rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Agents of each cell.
AGENTS = {"A": 1, "B": 4, "C": 7}
# USD per million input and output tokens.
PRICES = {"model-one": (5, 25), "model-two": (5, 30)}
# Caps of a run or campaign.
CALL_CAP = 400
CAPS = {
    "calls": 400, "attempts_per_item": 3, "agents": 8, "followups": 24, "depth": 3, "artifact_bytes": 10 << 20, "artifact_bytes_total": 200 << 20,
    "campaign_usd": 500, "campaign_days": 14, "measurement_usd": 50, "measurement_days": 2,
}
RUN_HOURS = {"A": 2, "B": 2, "C": 4}
#: Total input tokens above which a call is priced at twice the input and one and a half times the output price.
LONG_CONTEXT = 272_000
#: Complete and fully measured runs of each cell that a decision takes.
RUNS_PER_CELL = 5
# Cells of the blocks of each pilot, in the order of their runs.
SCHEDULE = {"research": ("CAB", "ACB", "BAC", "CAB", "BCA"), "change": ("CAB", "CAB", "ABC", "CAB", "ABC")}
# The records that are an agent's own action.
AGENT_ACTIONS = ("dispatch", "attempt", "model_call", "busy_interval")


def ratio(num: Column, den: Column, empty: float | None) -> Column:
    """num / den to six places, and what an empty denominator means."""
    return F.when(den == 0, F.lit(empty).cast("double")).otherwise(F.round(num / den, 6))


def agents() -> Column:
    """Agents of the row's cell."""
    out = F.lit(None).cast("int")
    for cell, n in AGENTS.items():
        out = F.when(F.col("cell") == cell, n).otherwise(out)
    return out


def call_cost() -> Column:
    """Nano-dollars of a call: cached input counts as input, long contexts cost more; null for a model without a price."""
    taken = F.col("input_tokens") + F.coalesce("cached_input_tokens", F.lit(0))
    long_context = taken > LONG_CONTEXT
    nano = F.lit(None).cast("long")
    for model, (i, o) in PRICES.items():
        price = taken * F.when(long_context, 2000 * i).otherwise(1000 * i) + F.col("output_tokens") * F.when(long_context, 1500 * o).otherwise(1000 * o)
        nano = F.when(F.col("model") == model, price).otherwise(nano)
    return nano


def cost(calls: DataFrame) -> DataFrame:
    """Cost of each run and phase in nano-dollars (integers), and the calls made; treatment and measurement stay apart.

    Calls of models without a price are counted, and leave the cost of their run and phase unknown (null).
    """
    priced = calls.withColumn("__nano", call_cost())
    unpriced = F.count_if(F.col("__nano").isNull())
    out = priced.groupBy("run_seq", "phase").agg(F.when(unpriced == 0, F.sum("__nano")).alias("nano_usd"), unpriced.alias("unpriced"), F.count("*").alias("calls"))
    return out.withColumn("over_cap", (F.col("phase") == "treatment") & (F.col("calls") > CALL_CAP))


def cost_per_resolved(costs: DataFrame, resolved: DataFrame) -> DataFrame:
    """Whole nano-dollars of all phases per resolved target of each run; undefined (null) without one."""
    spent = costs.groupBy("run_seq").agg(F.when(F.sum("unpriced") == 0, F.sum("nano_usd")).alias("nano_usd"))
    return resolved.select("run_seq", "resolved").join(spent, "run_seq", "left").select("run_seq", F.expr("CASE WHEN resolved <> 0 THEN nano_usd DIV resolved END").alias("nano_usd_per_target"))


def utilization(intervals: DataFrame) -> DataFrame:
    """Busy share of each run: durations summed per host, never instants compared across hosts."""
    per_host = intervals.groupBy("run_seq", "host_id").agg(F.sum("busy_ms").alias("busy"), F.sum("life_ms").alias("life"))
    return per_host.groupBy("run_seq").agg(F.sum("busy").alias("busy_ms"), F.sum("life").alias("life_ms")).withColumn("utilization", ratio(F.col("busy_ms"), F.col("life_ms"), None))


def wall_clock(runs: DataFrame, records: DataFrame) -> DataFrame:
    """Wall clock of each run: research from the first action of an agent to the end of treatment, change from the start to the end of measurement.

    ``runs`` has start_ms, treatment_end_ms and measurement_end_ms, ``records`` run_seq, record and ts_ms.
    A research run without any action has none (null).
    """
    first = records.filter(F.col("record").isin(*AGENT_ACTIONS)).groupBy("run_seq").agg(F.min("ts_ms").alias("first_ms"))
    wall = F.when(F.col("pilot") == "research", F.col("treatment_end_ms") - F.col("first_ms")).otherwise(F.col("measurement_end_ms") - F.col("start_ms"))
    return runs.join(first, "run_seq", "left").select("run_seq", "pilot", "cell", wall.alias("wall_ms"))


def efficiency(counts: DataFrame) -> DataFrame:
    """Outcome of each run against the median of its campaign's single-agent runs, per agent; undefined (null) if that is 0.

    ``counts`` has run_seq, campaign, pilot, cell and outcome (supported conclusions, or resolved targets).
    """
    base = counts.filter("cell = 'A'").groupBy("campaign", "pilot").agg(F.median("outcome").alias("base"))
    j = counts.join(base, ["campaign", "pilot"], "left")
    return j.select("run_seq", "campaign", "pilot", "cell", F.round(F.when(F.col("base") != 0, F.col("outcome") / F.col("base") / agents()), 6).alias("efficiency"))


def scaling(wall: DataFrame) -> DataFrame:
    """Median wall clock per cell against one agent: speedup, and efficiency per agent; a zero median is undefined."""
    m = wall.groupBy("pilot", "cell").agg(F.median("wall_ms").alias("median_ms"), F.count("*").alias("runs"))
    base = m.filter("cell = 'A'").select("pilot", F.col("median_ms").alias("base_ms"))
    speedup = F.when(F.col("median_ms") != 0, F.col("base_ms") / F.col("median_ms"))
    return m.join(base, "pilot", "left").select("pilot", "cell", "runs", F.round("median_ms", 6).alias("median_ms"), F.round(speedup, 6).alias("speedup"), F.round(speedup / agents(), 6).alias("efficiency"))


def omission(reference: DataFrame, matched: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Reference items of each run without a match, and their share; struck items leave the set, and an empty set means 0.

    ``reference`` has run_seq, item and, if items can be struck, ``struck``; ``runs`` adds runs without reference items.
    """
    kept = reference.filter(~F.coalesce("struck", F.lit(False))) if "struck" in reference.columns else reference
    m = matched.select("run_seq", "item").distinct().withColumn("hit", F.lit(True))
    out = kept.select("run_seq", "item").distinct().join(m, ["run_seq", "item"], "left").groupBy("run_seq").agg(F.count_if(F.col("hit").isNull()).alias("omitted"), F.count("*").alias("reference"))
    if runs is not None:
        out = runs.select("run_seq").join(out, "run_seq", "left").na.fill(0, ["omitted", "reference"])
    return out.withColumn("rate", ratio(F.col("omitted"), F.col("reference"), 0.0))


def rates(candidates: DataFrame, integrations: DataFrame) -> DataFrame:
    """Correction, rejection and conflict rates of each run over what was judged, produced and attempted; without any of these a rate is undefined (null).

    ``candidates`` has run_seq, judged, corrected (revised or rejected on the judge's word) and rejected; ``integrations`` run_seq and outcome.
    """
    c = candidates.groupBy("run_seq").agg(F.count_if(F.col("judged") & F.col("corrected")).alias("corrections"), F.count_if("judged").alias("judged"), F.count_if("rejected").alias("rejections"), F.count("*").alias("produced"))
    i = integrations.groupBy("run_seq").agg(F.count_if(F.col("outcome") == "conflict").alias("conflicts"), F.count("*").alias("attempted"))
    part = lambda n, d, name: ratio(F.col(n), F.coalesce(d, F.lit(0)), None).alias(name)
    return c.join(i, "run_seq", "full_outer").select("run_seq", part("corrections", "judged", "correction_rate"), part("rejections", "produced", "rejection_rate"), part("conflicts", "attempted", "conflict_rate"))


def resolutions(inventory: DataFrame, evaluations: DataFrame, integrated: DataFrame, runs: DataFrame) -> DataFrame:
    """Targets of each run that are resolved (the condition holds and every evaluator passes), and targets left out.

    ``inventory`` has campaign, target and exempt, ``evaluations`` run_seq, target, resolved and passed (a row
    per evaluator), ``integrated`` run_seq and target, ``runs`` run_seq and campaign.
    """
    each = evaluations.groupBy("run_seq", "target").agg((F.bool_and("passed") & F.bool_and("resolved")).alias("ok"))
    good = each.groupBy("run_seq").agg(F.count_if("ok").alias("resolved"))
    asked = inventory.filter(~F.col("exempt")).select("campaign", "target").distinct()
    size = asked.groupBy("campaign").agg(F.count("*").alias("targets"))
    done = integrated.select("run_seq", "target").distinct().join(runs.select("run_seq", "campaign"), "run_seq").join(asked, ["campaign", "target"], "left_semi").groupBy("run_seq").agg(F.count("*").alias("done"))
    j = runs.select("run_seq", "campaign").join(size, "campaign", "left").join(good, "run_seq", "left").join(done, "run_seq", "left").na.fill(0, ["targets", "resolved", "done"])
    return j.select("run_seq", "resolved", (F.col("targets") - F.col("done")).alias("omitted"))


def rediscovery(found: DataFrame, reports: DataFrame) -> DataFrame:
    """Whether each run's final rediscovery passes: it has a valid report with the campaign's rule digest, and finds nothing unresolved that isn't exempt.

    ``reports`` has run_seq, rule_digest and expected_digest; ``found`` run_seq and exempt.
    """
    left = found.filter(~F.col("exempt")).groupBy("run_seq").agg(F.count("*").alias("left"))
    ok = F.coalesce(F.col("rule_digest") == F.col("expected_digest"), F.lit(False)) & F.col("left").isNull()
    return reports.join(left, "run_seq", "left").select("run_seq", F.when(ok, "pass").otherwise("fail").alias("verdict"))


def discriminating(followups: DataFrame) -> DataFrame:
    """Different follow-up investigations of each run whose evidence changed the outcome class of a conclusion.

    ``followups`` has run_seq, followup, class_before and class_after.
    """
    changed = ~F.col("class_before").eqNullSafe(F.col("class_after"))
    return followups.groupBy("run_seq").agg(F.count_distinct(F.when(changed, F.col("followup"))).alias("discriminating"))


def duplicate_work(classes: DataFrame) -> DataFrame:
    """Conclusions of each run that fell to an equal one (``equivalence_classes`` rows that don't stand for their class)."""
    return classes.groupBy("run_seq").agg(F.count_if(~F.col("kept")).alias("duplicates"))


def caps(usage: DataFrame) -> DataFrame:
    """Which caps each run exceeds (sorted names), and its status: a run beyond a cap is unresolved.

    ``usage`` has run_seq, cell, hours and the columns of CAPS that are known; null means nothing used.
    """
    hours = F.lit(None).cast("int")
    for cell, n in RUN_HOURS.items():
        hours = F.when(F.col("cell") == cell, n).otherwise(hours)
    over = [F.when(F.col(c) > n, F.lit(c)) for c, n in sorted(CAPS.items()) if c in usage.columns] + [F.when(F.col("hours") > hours, F.lit("hours"))]
    names = F.array_sort(F.array_compact(F.array(*over)))
    return usage.select("run_seq", names.alias("exceeded"), F.when(F.size(names) > 0, "unresolved").otherwise("within").alias("status"))


def grades(verdicts: DataFrame) -> DataFrame:
    """Supported, incorrect and unresolved conclusions of each run, both judges agreeing; nothing graded counts as wholly incorrect."""
    both = F.when((F.col("judge_one") == F.col("judge_two")) & F.col("judge_one").isin("supported", "incorrect"), F.col("judge_one")).otherwise("unresolved")
    g = verdicts.withColumn("grade", both).groupBy("run_seq").agg(*(F.count_if(F.col("grade") == k).alias(k) for k in ("supported", "incorrect", "unresolved")), F.count_distinct(F.when(F.col("grade") == "supported", F.col("artifact"))).alias("useful_artifacts"))
    return g.withColumn("incorrect_rate", ratio(F.col("incorrect"), F.col("supported") + F.col("incorrect"), 1.0))


def wasted(attempts: DataFrame, integrated: DataFrame) -> DataFrame:
    """Attempts of each run that nothing integrated came of."""
    return attempts.join(integrated.select("run_seq", "item").distinct(), ["run_seq", "item"], "left_anti").groupBy("run_seq").agg(F.count("*").alias("wasted"))


def idle(spans: DataFrame, runs: DataFrame) -> DataFrame:
    """Time of each run in which work waits and none is in flight: a sweep over starts and ends; 0 for cells without a controller (A and B).

    ``spans`` has run_seq, kind (queued or busy), start_ms and end_ms; ``runs`` run_seq and cell.
    """
    steered = spans.join(runs.filter("cell = 'C'").select("run_seq"), "run_seq", "left_semi")
    step = lambda at, n: steered.select("run_seq", F.col(at).alias("ts"), F.when(F.col("kind") == "queued", n).otherwise(0).alias("queued"), F.when(F.col("kind") == "busy", n).otherwise(0).alias("busy"))
    moves = step("start_ms", 1).unionByName(step("end_ms", -1)).groupBy("run_seq", "ts").agg(F.sum("queued").alias("queued"), F.sum("busy").alias("busy"))
    w = Window.partitionBy("run_seq").orderBy("ts")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    state = moves.select("run_seq", F.sum("queued").over(run).alias("queued"), F.sum("busy").over(run).alias("busy"), (F.lead("ts").over(w) - F.col("ts")).alias("span"))
    waits = state.groupBy("run_seq").agg(F.sum(F.when((F.col("queued") > 0) & (F.col("busy") == 0), F.col("span"))).alias("waits"))
    return runs.select("run_seq").join(waits, "run_seq", "left").select("run_seq", F.coalesce("waits", F.lit(0)).cast("long").alias("idle_ms"))


def decide(measures: DataFrame, least_runs: int = RUNS_PER_CELL) -> DataFrame:
    """Per campaign and pilot, C against A on medians over complete and fully measured runs.

    Unless every cell has exactly ``least_runs`` of them the outcome is budget_stopped.  Research succeeds
    with more supported conclusions and neither rate above A's, and fails with fewer, or with both rates above.
    Change succeeds with more resolved targets if every C run passes rediscovery, and fails with fewer, or if one doesn't.
    ``measures`` has campaign, pilot, cell, measured, outcome (supported or resolved), incorrect_rate, omission_rate and passed.
    """
    cell = lambda c: F.col("measured") & (F.col("cell") == c)
    middle = lambda c, x, name: F.median(F.when(cell(c), F.col(x))).alias(name)
    m = measures.groupBy("campaign", "pilot").agg(
        *(F.count_if(cell(c)).alias(f"n_{c}") for c in AGENTS), *(middle(c, x, f"{x}_{c}") for c in "AC" for x in ("outcome", "incorrect_rate", "omission_rate")), F.bool_and(F.when(cell("C"), F.coalesce("passed", F.lit(False)))).alias("all_pass")
    )
    wrong, omitted = (F.col(f"{x}_C") > F.col(f"{x}_A") for x in ("incorrect_rate", "omission_rate"))
    more, fewer = F.col("outcome_C") > F.col("outcome_A"), F.col("outcome_C") < F.col("outcome_A")
    change = F.col("pilot") == "change"
    failure = F.when(change, fewer | ~F.col("all_pass")).otherwise(fewer | (wrong & omitted))
    success = F.when(change, more & F.col("all_pass")).otherwise(more & ~wrong & ~omitted)
    full = F.coalesce((F.col("n_A") == least_runs) & (F.col("n_B") == least_runs) & (F.col("n_C") == least_runs), F.lit(False))
    verdict = F.when(~full, "budget_stopped").when(failure, "failure").when(success, "success").otherwise("inconclusive")
    return m.select("campaign", "pilot", verdict.alias("verdict"))


def schedule_verdicts(runs: DataFrame) -> DataFrame:
    """Whether each run (campaign, run_no from 1, pilot, cell) is the one that the blocked schedule has at its place: scheduled, misplaced, or beyond."""
    order = [(pilot, cell) for pilot, blocks in SCHEDULE.items() for block in blocks for cell in block]
    planned = F.array(*(F.struct(F.lit(p).alias("pilot"), F.lit(c).alias("cell")) for p, c in order))
    own = F.get(planned, (F.col("run_no") - 1).cast("int"))
    verdict = F.when(own.isNull(), "beyond").when((own["pilot"] == F.col("pilot")) & (own["cell"] == F.col("cell")), "scheduled").otherwise("misplaced")
    return runs.select("campaign", "run_no", verdict.alias("verdict"))


def escrow(entries: DataFrame) -> DataFrame:
    """Whether what was escrowed equals what was confirmed, returned and quarantined."""
    part = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("units"))), F.lit(0)).cast("long")
    s = entries.groupBy("scope_id").agg(part("escrowed").alias("escrowed"), (part("confirmed") + part("returned") + part("quarantined")).alias("settled"))
    return s.withColumn("conserved", F.col("escrowed") == F.col("settled"))


def invalid_attempts(calls: DataFrame) -> DataFrame:
    """Calls that count, and slots that they consume: failures without content consume none."""
    free = F.col("outcome").isin("rate_limited", "timed_out", "unknown", "proven_not_sent") & ~F.col("has_content")
    return calls.groupBy("run_seq").agg(F.count("*").alias("calls"), F.count_if(~free).alias("slots"))


def ready_latency(claims: DataFrame, evidence: DataFrame, dependencies: DataFrame, start: DataFrame) -> DataFrame:
    """How long each claim came after its work was ready: ready_ms, latency_ms = at_ms - ready_ms, both null if it wasn't ready.

    Work is ready at the latest of its scope's start and, for each dependency, the last evidence at or before the
    claim; a dependency without such evidence leaves it unready.  ``claims`` has the key, claim_id and at_ms, ``evidence``
    the key and at_ms, ``dependencies`` the key and depends_on_work_id and _revision, ``start`` scope_id and start_ms.

    The as-of join is one union sorted by (dependency, time), evidence before claims of the same time, over which
    the last evidence runs on: each side is shuffled once, and no claim meets evidence but the one it takes.
    """
    key = ["scope_id", "work_id", "work_revision"]
    asks = claims.join(dependencies, key).select("scope_id", F.col("depends_on_work_id").alias("on_id"), F.col("depends_on_work_revision").alias("on_revision"), "at_ms", F.lit(1).alias("side"), "claim_id")
    gives = evidence.select("scope_id", F.col("work_id").alias("on_id"), F.col("work_revision").alias("on_revision"), "at_ms", F.lit(0).alias("side"), F.lit(None).cast(claims.schema["claim_id"].dataType).alias("claim_id"))
    w = Window.partitionBy("scope_id", "on_id", "on_revision").orderBy("at_ms", "side").rowsBetween(Window.unboundedPreceding, 0)
    last = gives.unionByName(asks).withColumn("seen_ms", F.last(F.when(F.col("side") == 0, F.col("at_ms")), ignorenulls=True).over(w)).filter("side = 1")
    held = last.groupBy("scope_id", "claim_id").agg(F.max("seen_ms").alias("seen_ms"), F.bool_or(F.col("seen_ms").isNull()).alias("open"))
    j = claims.join(held, ["scope_id", "claim_id"], "left").join(start, "scope_id", "left")
    ready = F.when(~F.coalesce("open", F.lit(False)), F.greatest("start_ms", "seen_ms"))
    return j.select(*key, "claim_id", ready.alias("ready_ms"), (F.col("at_ms") - ready).alias("latency_ms"))


def claim_collisions(folded: DataFrame, operations: DataFrame) -> DataFrame:
    """Share of each scope's claim operations that met another's live lease, a lower fence or a closed revision: refused of ``fold_claims`` over all ``operations``; no operation gives no row."""
    refused = folded.groupBy("scope_id").agg(F.sum("refused").alias("refused"))
    made = operations.groupBy("scope_id").agg(F.count("*").alias("operations"))
    return made.join(refused, "scope_id", "left").select("scope_id", "operations", F.coalesce("refused", F.lit(0)).alias("refused"), ratio(F.coalesce("refused", F.lit(0)), F.col("operations"), 0.0).alias("rate"))
