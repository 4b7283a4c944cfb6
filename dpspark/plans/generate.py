"""Rows from a release, by a decoder: a statistical one in Spark, or a model that is asked for text.

The statistical decoder needs nothing but the release. Its quotas are expanded
into rows; columns are put together at random within a cohort and class.
"""

from __future__ import annotations

import csv
import hashlib
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark import AccumulatorParam
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dpspark.errors import ContextTruncationError, EmptyContentError, FatalAPIError, GenerationError, ModelRefusalError, PromptIntegrityError, RateLimitedError
from dpspark.domains import frame
from dpspark.functions import binning
from dpspark.functions.draw import uniform
from dpspark.models import ADEQUATE, VALIDATED, ModelTable, SpendMeter, fits_context
from dpspark.operators import counts, quota
from dpspark.operators.parsing import LEAST_HEADER, parsed, validated
from dpspark.operators.sampling import GROUP_ROWS, numbered
from dpspark.plans.release import Release
from dpspark.plans.selection import SUB_BINS, select_to_release, sub_bin_redraw
from dpspark.schema import PublicSchema
from dpspark.sources.tables import kept, kept_while, shared_path

# Fixed values of generation.
ROWS_PER_CALL, ATTEMPTS, POOL_FACTOR = 25, 3, 3
YIELD_LEAST, PARSE_LEAST, CHECKED_FROM, CHECKED_EVERY = 0.40, 0.40, 60, 2
NUMERIC_SHOWN, CATEGORY_SHOWN, CHARS_PER_TOKEN = 0.005, 0.001, 3.5
BACKOFF_FIRST, BACKOFF_MOST, BACKOFF_TIMES = 15, 240, 6
#: Calls of one round at most; the first round has CHECKED_EVERY, each later one twice as many.
ROUND_MOST = 4096
#: A running round is ended when so few of its last RECENT calls gave a row that can be used.
RECENT = 32

TEMPLATE = """You write rows of a table that does not exist. Columns: {columns}.
Group: {cohort}. Write {n} rows as CSV with a header line and nothing else.
The counts below hold for exactly these {n} rows.
{counts}
"""
CELL_TEMPLATE = """You write rows of a table that does not exist. Columns: {columns}.
Every row is of this group: {cohort}. Write {n} rows as CSV with a header line and nothing else.
{counts}
"""
REQUIRED = ("{columns}", "{n}", "{counts}", "CSV")
_templates: dict[str, tuple[str, str]] = {}


def register_template(name: str, text: str) -> str:
    """Locks a template by its hash, which it returns; the fields that every template needs have to be there."""
    if missing := [p for p in REQUIRED if p not in text]:
        raise PromptIntegrityError(f"the template lacks {missing}")
    digest = hashlib.sha256(text.encode()).hexdigest()
    _templates[name] = text, digest
    return digest


def template(name: str) -> str:
    text, digest = _templates[name]
    if hashlib.sha256(text.encode()).hexdigest() != digest:
        raise PromptIntegrityError("the template is not what was registered")
    return text


register_template("rows", TEMPLATE)
register_template("cell", CELL_TEMPLATE)


def counts_text(quotas: dict) -> str:
    lines = [f"outcome: {', '.join(f'{k} x {n}' for k, n in quotas['outcome'].items())}"]
    for cls, columns in quotas["columns"].items():
        lines += [f"{col}{'' if cls == 'all' else f' where outcome is {cls}'}: {', '.join(f'{k} x {n}' for k, n in x.items() if n)}" for col, x in columns.items()]
    return "\n".join(lines)


def prompt(schema: PublicSchema, cohort: dict, n: int, quotas: dict) -> str:
    said = f"{counts_text(quotas)}\nShares in the whole group, for what the counts leave open:\n{block_text(schema, cohort)}"
    return template("rows").format(columns=", ".join(schema.columns), cohort=cohort["cohort_name"], n=n, counts=said)


def block_text(schema: PublicSchema, cohort: dict) -> str:
    """A cohort's released shares in words; those that round to nothing are left out."""
    lines = []
    for c, h in cohort["numerical"].items():
        lines.append(f"{c}: " + ", ".join(f"{binning.quota_label(h['bin_edges'], i)} {p:.1%}" for i, p in enumerate(h["proportions"]) if p >= NUMERIC_SHOWN))
    for c, h in cohort["categorical"].items():
        lines.append(f"{c}: " + ", ".join(f"{v} {float(p):.1%}" for v, p in h.items() if float(p) >= CATEGORY_SHOWN))
    return "\n".join(lines)


def cell_text(schema: PublicSchema, release: Release, cell: str, columns: list[str]) -> str:
    """A cell in words: a group of categories with its members and their shares within it."""
    shares, out = quota.mixture(schema, release), []
    for part, col in zip(cell.split(" & "), columns, strict=False):
        value = part.removeprefix(f"{col}=")
        members = [v for v, g in release.coarsen.get(col, {}).items() if g == value]
        if members:
            total = sum(shares[col].get(m, 0.0) for m in members) or 1.0
            out.append(f"{col} is one of " + ", ".join(f"{m} ({shares[col].get(m, 0.0) / total:.0%})" for m in members))
        else:
            out.append(part)
    return "; ".join(out)


def cell_prompt(schema: PublicSchema, release: Release, cell: str, columns: list[str], n: int, positives: int) -> str:
    """Rows of one cell, with the number of positives as a count; the cell's own columns are not told again."""
    shares = quota.mixture(schema, release)
    lines = [f"{schema.target}: exactly {positives} x {schema.positive}, {n - positives} x {schema.negative}", "Shares in the whole table:"]
    for c, h in shares.items():
        if c not in columns:
            least = NUMERIC_SHOWN if c in schema.numerical else CATEGORY_SHOWN
            lines.append(f"{c}: " + ", ".join(f"{v} {p:.1%}" for v, p in h.items() if p >= least))
    return template("cell").format(columns=", ".join(schema.columns), cohort=cell_text(schema, release, cell, columns), n=n, counts="\n".join(lines))


@dataclass
class Answer:
    """What a decoder may return in place of a text, with the tokens that its service counted; ``reasoning`` None: it doesn't say."""

    text: str
    tokens_in: int | None = None
    tokens_out: int | None = None
    reasoning: int | None = None


@dataclass(frozen=True)
class Service:
    """The model behind a decoder. With a table of models it has to be one that ``allow`` names; prices come from the table."""

    model: str = ""
    table: ModelTable | None = None
    allow: tuple[str, ...] = (VALIDATED, ADEQUATE)
    context: int | None = None
    output_tokens: int = 4096
    budget_usd: float | None = None
    reasoning: bool = False


@dataclass
class GenerationStats:
    requested: int = 0
    calls: int = 0
    rows_asked: int = 0
    rows_parsed: int = 0
    rows_kept: int = 0
    useful_calls: int = 0
    failed_calls: int = 0
    turned_down: dict[str, int] = field(default_factory=dict)
    cost_usd: float = 0.0
    budget_capped: bool = False
    positives_asked: int = 0
    positives_made: int = 0
    positives_missed: int = 0
    without_reasoning: int = 0
    reasoning_unknown: int = 0
    warnings: list[str] = field(default_factory=list)


def manifest(spark: SparkSession, schema: PublicSchema, release: Release, n: int, seed: int, by_class: bool = True) -> DataFrame:
    """(cohort, cls, label, col, kind, bin, quota): what the decoder has to make."""
    rows, rng = [], random.Random(seed)
    sizes = quota.allocate_rows(release, n)
    for c in release.cohorts:
        found = quota.batch_quotas(schema, c, sizes[c["cohort_name"]], rng, by_class)
        rows += [(c["cohort_name"], "all", schema.target, "label", i, v, k) for i, (v, k) in enumerate(found["outcome"].items())]
        for cls, columns in found["columns"].items():
            for col, x in columns.items():
                kind = "numeric" if col in schema.numerical else "categorical"
                rows += [(c["cohort_name"], cls, col, kind, i, v, k) for i, (v, k) in enumerate(x.items())]
    return frame(spark, rows, "cohort string, cls string, col string, kind string, bin int, value string, quota long").where("quota > 0")


def statistical(spark: SparkSession, schema: PublicSchema, release: Release, n: int, seed: int = 0, by_class: bool = True) -> DataFrame:
    """(row_id, _cohort, columns): ``n`` rows with exactly the quotas' counts, columns independent within cohort and class."""
    release.belongs_to(schema)
    release_schema = release.effective_schema(schema)
    wanted = manifest(spark, release_schema, release, n, seed, by_class)
    units = wanted.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "quota"))).drop("quota")
    key = F.concat_ws("|", "cohort", "cls", "col", F.col("bin").cast("string"), F.col("copy").cast("string"))
    # labels of blocks by class are the class itself; others are dealt out like any column
    labels = units.where(F.col("kind") == "label")
    blocks = wanted.where("cls <> 'all'").select("cohort", F.col("cls").alias("value"), F.col("cls").alias("block")).distinct()
    own = labels.join(F.broadcast(blocks), ["cohort", "value"], "left").select("cohort", F.coalesce("block", "cls").alias("cls"), "col", "kind", "bin", "value", "copy")
    both = own.unionByName(units.where(F.col("kind") != "label"))
    placed = numbered(both, uniform(key, seed), "place", ["cohort", "cls", "col"], ["bin", "copy"], max(1, n // GROUP_ROWS))
    wide = placed.groupBy("cohort", "cls", "place")
    wide = wide.agg(*(F.max(F.when(F.col("col") == c, F.struct("bin", "value"))).alias(c) for c in release_schema.columns))
    row = F.concat_ws("|", "cohort", "cls", F.col("place").cast("string"))
    out = []
    for c in release_schema.numerical:
        edges = release_schema.edges(c)
        lo, hi = F.get(F.array(*map(F.lit, edges[:-1])), F.col(c).bin), F.get(F.array(*map(F.lit, edges[1:])), F.col(c).bin)
        out.append((lo + uniform(row, f"{seed} {c}") * (hi - lo)).alias(c))
    out += [F.col(c).value.alias(c) for c in [*release_schema.categorical, release_schema.target]]
    return wide.select(row.alias("row_id"), F.col("cohort").alias("_cohort"), *out)


def check_coverage(schema: PublicSchema, release: Release, level: int, allow_low_coverage: bool) -> None:
    low = [c for c, x in quota.band_coverage(schema, release, level).items() if x < quota.COVERAGE - 1e-9]
    if low and not allow_low_coverage:
        raise GenerationError(f"released cells cover less than {quota.COVERAGE:.0%} of {low}: rows by cell would drop the rest")


def by_cell(spark: SparkSession, schema: PublicSchema, release: Release, n: int, level: int = 0, allow_low_coverage: bool = False, seed: int = 0) -> DataFrame:
    """(cell, rows, positives): rows by support, positives by the released rate, rounded without bias."""
    if level >= len(release.conditional_levels):
        raise GenerationError("the release has no such level")
    check_coverage(schema, release, level, allow_low_coverage)
    cells, rng = release.conditional_levels[level]["cells"], random.Random(seed)
    rows = quota.apportion([c["support"] for c in cells.values()], n)
    return frame(spark, [(k, r, quota.positives(c["rate"], r, rng.random())) for (k, c), r in zip(cells.items(), rows, strict=True)], "cell string, rows long, positives long")


def ask(decoder: Callable[[str], str], text: str, wait: Callable[[float], None]) -> str:
    """One call, again after a pause where the service asks for one; a refusal is final."""
    pause = BACKOFF_FIRST
    for turn in range(BACKOFF_TIMES + 1):
        try:
            return decoder(text)
        except (ModelRefusalError, FatalAPIError):
            raise
        except RateLimitedError:
            if turn == BACKOFF_TIMES:
                raise
            wait(pause)
            pause = min(BACKOFF_MOST, pause * 2)
    raise AssertionError


@dataclass
class Group:
    """A cohort or a cell that is asked for in batches. write: size and what is made or asked for already, to a prompt and its quotas."""

    name: str
    want: int
    write: Callable[[int, dict], tuple[str, dict]]
    got: int = 0
    attempts: int = 0
    done: dict = field(default_factory=dict)


FATAL = {e.__name__: e for e in (ModelRefusalError, FatalAPIError, EmptyContentError, ContextTruncationError)}
ANSWERS = "response_id long, _group string, response string, tokens_in long, tokens_out long, reasoning long, failure string, said string"


def usable(schema: PublicSchema) -> Callable[[str], bool]:
    """Whether an answer has a header and a line of its width with a label; a first look, which rows are valid is seen later."""
    names, labels = set(schema.columns), {str(schema.positive), str(schema.negative)}

    def look(text: str) -> bool:
        head: list[str] = []
        for row in csv.reader(text.splitlines()):
            row = [x.strip() for x in row]
            if not head and len(names.intersection(row)) >= LEAST_HEADER * len(names):
                head = row
            elif head and len(row) == len(head) and schema.target in head and row[head.index(schema.target)] in labels:
                return True
        return False

    return look


class _Flags(AccumulatorParam):
    """Of the calls that ended, in that order: was the answer usable? One list, as long as a round has calls at most."""

    def zero(self, value: list) -> list:
        return []

    def addInPlace(self, a: list, b: list) -> list:  # noqa: N802
        a.extend(b)
        return a


def answered(calls: DataFrame, decoder: Callable[[str], str | Answer], look: Callable[[str], bool] | None = None) -> tuple[DataFrame, bool]:
    """One answer of the decoder for each call; what goes wrong is a row too, so that Spark doesn't repeat paid calls. Evaluated once.

    A task has CHECKED_EVERY calls. When it ends its answers are in shared
    storage, and the driver sees how many were usable: if of the last RECENT
    calls fewer than PARSE_LEAST were, the job is cancelled. The second value
    says so; calls without an answer were not made, or not paid for twice.
    """
    spark, n = calls.sparkSession, calls.count()
    flags = spark.sparkContext.accumulator([], _Flags())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        for batch in batches:
            rows = []
            for number, group, text in zip(batch["response_id"].to_pylist(), batch["_group"].to_pylist(), batch["prompt"].to_pylist(), strict=True):
                try:
                    found = ask(decoder, text, time.sleep)
                    a = found if isinstance(found, Answer) else Answer(found)
                    rows.append((number, group, a.text, a.tokens_in, a.tokens_out, a.reasoning, None, None))
                except Exception as e:  # whatever a client library raises: the call failed, and is counted as such
                    rows.append((number, group, None, None, None, None, type(e).__name__, str(e)))
                flags.add([rows[-1][2] is not None and (look is None or look(rows[-1][2]))])
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [x.split()[0] for x in ANSWERS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=names)

    def going_on() -> bool:
        last = flags.value[-RECENT:]
        return len(last) < RECENT or sum(last) >= PARSE_LEAST * RECENT

    dealt = calls.repartitionByRange(max(1, -(-n // CHECKED_EVERY)), "response_id")
    return kept_while(dealt.mapInArrow(each, ANSWERS), shared_path(spark), going_on)


def _made(schema: PublicSchema, found: list, edges: dict[str, list[float]], by_class: bool) -> dict:
    """Counts of a group's valid rows in the form of quotas. found: rows (cls, col, bin, n); a null column counts rows."""
    label = {counts.POSITIVE: str(schema.positive), counts.NEGATIVE: str(schema.negative)}
    out: dict = {"outcome": {}, "columns": {}}
    for r in found:
        if r["col"] is None:
            out["outcome"][label[r["cls"]]] = r["n"]
            continue
        name = binning.quota_label(edges[r["col"]], r["bin"]) if r["col"] in edges else schema.levels(r["col"])[r["bin"]]
        column = out["columns"].setdefault(label[r["cls"]] if by_class else "all", {}).setdefault(r["col"], {})
        column[name] = column.get(name, 0) + r["n"]
    return out


def _guard(stats: GenerationStats) -> None:
    if stats.calls >= CHECKED_EVERY and stats.useful_calls < PARSE_LEAST * stats.calls:
        raise GenerationError(f"only {stats.useful_calls} of {stats.calls} calls gave a row that can be used")
    if stats.rows_asked >= CHECKED_FROM and stats.rows_kept < YIELD_LEAST * stats.rows_asked:
        raise GenerationError(f"only {stats.rows_kept} of {stats.rows_asked} rows asked for were valid: {stats.turned_down}")


def _with_paid(error: GenerationError, paid: list[str]) -> GenerationError:
    """The error, with the paths of the rows of all rounds, in its text too."""
    out = type(error)(f"{error} (rows until then: {', '.join(paid)})")
    out.paid = list(paid)
    return out


def _warn(stats: GenerationStats, service: Service) -> None:
    if stats.budget_capped:
        stats.warnings.append(f"the budget of ${service.budget_usd:.2f} is used up after {stats.calls} calls: {stats.rows_kept} rows of {stats.requested}")
    if stats.positives_missed:
        stats.warnings.append(f"{stats.positives_missed} calls missed the number of positives asked for by more than one ({stats.positives_made} made, {stats.positives_asked} asked for)")
    if service.reasoning and stats.without_reasoning:
        stats.warnings.append(f"{stats.without_reasoning} of {stats.calls} calls report no reasoning, though it was asked for")
    if service.reasoning and stats.reasoning_unknown:
        stats.warnings.append(f"{stats.reasoning_unknown} of {stats.calls} calls don't say whether the model reasoned")


def _rounds(spark: SparkSession, schema: PublicSchema, groups: list[Group], decoder: Callable[[str], str | Answer], service: Service, rows_per_call: int, edges: dict[str, dict], by_class: dict[str, bool]) -> tuple[DataFrame, GenerationStats]:
    """Asks in rounds until every group has its rows, its attempts or the budget are used up, or too little comes back.

    A round is one Spark job over its calls. It starts with as many as are made
    between two checks and doubles, so that little is paid for before the first
    ones; a round that goes bad is ended while it runs. What comes to the driver
    are counts by call and by public bin. An error names the tables of the rows
    that were paid for until then (``paid``).
    """
    if service.table is not None:
        service.table.check(service.model, service.allow)
    meter = SpendMeter(service.table or ModelTable(), service.model, service.budget_usd)
    stats, found, number, width, paid = GenerationStats(sum(g.want for g in groups)), [], 0, CHECKED_EVERY, []
    while True:
        calls, bound = [], 0.0
        for g in groups:
            ahead, spoken = 0, g.done
            while len(calls) < width and g.got + ahead < g.want and g.attempts < ATTEMPTS * (g.want // rows_per_call + 1):
                size = min(rows_per_call, g.want - g.got - ahead)
                text, asked = g.write(size, spoken)
                if service.context and not fits_context(text, service.output_tokens, service.context, CHARS_PER_TOKEN):
                    raise ContextTruncationError(f"a prompt of {len(text)} characters and {service.output_tokens} tokens of output exceed the context of {service.context}")
                bound += meter.table.cost(service.model, int(len(text) / CHARS_PER_TOKEN), service.output_tokens)
                if not meter.affords(bound if calls else 0.0):
                    break
                calls.append((number, g.name, size, text, asked["outcome"].get(str(schema.positive), 0)))
                number, ahead, spoken, g.attempts = number + 1, ahead + size, quota.absorb(spoken, asked), g.attempts + 1
        if not calls:
            stats.budget_capped = any(g.got < g.want for g in groups) and not meter.affords(0.0)
            break
        asked = spark.createDataFrame([c[:4] for c in calls], "response_id long, _group string, size long, prompt string")
        answers, ended = answered(asked, decoder, usable(schema))
        back = {r["response_id"]: r for r in answers.drop("response").collect()}
        texts = answers.where("response IS NOT NULL")
        rows = validated(parsed(texts, schema), schema).join(texts.select("response_id", "_group"), "response_id")
        paid.append(shared_path(spark))
        rows = kept(rows.select(F.concat_ws("|", "response_id", "line").alias("row_id"), "response_id", "_group", "reason", *schema.columns), paid[-1])
        if fatal := next((r for r in back.values() if r["failure"] in FATAL), None):
            raise _with_paid(FATAL[fatal["failure"]](fatal["said"]), paid)
        valid = rows.where("reason IS NULL").drop("reason")
        found.append(valid)
        tally = rows.groupBy("response_id", "reason").agg(F.count("*").alias("n"), F.count_if(schema.is_positive()).alias("p")).collect()
        sizes = valid.groupBy("_group", counts.class_column(schema).alias("cls")).agg(F.count("*").alias("n")).withColumns({"col": F.lit(None).cast("string"), "bin": F.lit(None).cast("int")})
        made = sizes.unionByName(counts.emitted(schema, valid, ["_group"])).collect()
        lengths = {r["response_id"]: r["n"] for r in answers.select("response_id", F.coalesce(F.length("response"), F.lit(0)).alias("n")).collect()}
        useful = {r["response_id"]: r for r in tally if r["reason"] is None}
        for number_, _, size, text, positives in calls:
            if number_ not in back:  # the round was ended before
                continue
            r = back[number_]
            stats.calls, stats.rows_asked, stats.failed_calls = stats.calls + 1, stats.rows_asked + size, stats.failed_calls + (r["failure"] is not None)
            tokens_in, tokens_out = r["tokens_in"], r["tokens_out"]
            meter.add(int(len(text) / CHARS_PER_TOKEN) if tokens_in is None else tokens_in, int(lengths[number_] / CHARS_PER_TOKEN) if tokens_out is None else tokens_out)
            stats.reasoning_unknown += r["reasoning"] is None
            stats.without_reasoning += r["reasoning"] == 0
            if number_ in useful:
                got = useful[number_]
                stats.useful_calls, stats.rows_kept = stats.useful_calls + 1, stats.rows_kept + got["n"]
                stats.positives_asked, stats.positives_made = stats.positives_asked + positives, stats.positives_made + got["p"]
                stats.positives_missed += abs(got["p"] - positives) > 1
        for r in tally:
            stats.rows_parsed += r["n"]
            if r["reason"] is not None:
                stats.turned_down[r["reason"]] = stats.turned_down.get(r["reason"], 0) + r["n"]
        of: dict[str, list] = {}
        for r in made:
            of.setdefault(r["_group"], []).append(r)
        for g in groups:
            if g.name not in of:
                continue
            new = _made(schema, of[g.name], edges[g.name], by_class[g.name])
            g.got, g.done = g.got + sum(new["outcome"].values()), quota.absorb(g.done, new)
        stats.cost_usd = meter.usd
        try:
            _guard(stats)
            if ended:
                raise GenerationError(f"too few of the last {RECENT} calls gave a row that can be used: a round of {len(calls)} calls was ended after {len(back)}")
        except GenerationError as e:
            raise _with_paid(e, paid) from None
        width = min(ROUND_MOST, 2 * width)
    if not stats.rows_kept:
        raise GenerationError("the budget was used up before there was a row" if stats.budget_capped else "no row could be used")
    _warn(stats, service)
    return reduce(DataFrame.unionByName, found).drop("response_id"), stats


def generate(spark: SparkSession, schema: PublicSchema, release: Release, n: int, decoder: Callable[[str], str | Answer], rows_per_call: int = ROWS_PER_CALL, seed: int = 0, service: Service | None = None, by_class: bool = True) -> tuple[DataFrame, GenerationStats]:
    """(row_id, _cohort, columns): valid rows out of a model's answers, cohort by cohort, and what they took.

    ``decoder`` takes a prompt and returns CSV text, or an ``Answer``. Each batch
    is told what its cohort still lacks; short batches are asked for again.
    """
    release.belongs_to(schema)
    effective, rng = release.effective_schema(schema), random.Random(seed)
    sizes = quota.allocate_rows(release, n)

    def group(c: dict) -> Group:
        target = quota.batch_quotas(effective, c, sizes[c["cohort_name"]], rng, by_class)

        def write(size: int, spoken: dict) -> tuple[str, dict]:
            owed = quota.remaining_quotas(target, spoken, size, rng)
            return prompt(effective, c, size, owed), owed

        return Group(c["cohort_name"], sizes[c["cohort_name"]], write)

    groups = [group(c) for c in release.cohorts if sizes[c["cohort_name"]] > 0]
    edges = {c["cohort_name"]: {k: h["bin_edges"] for k, h in c["numerical"].items()} for c in release.cohorts}
    split = {c["cohort_name"]: by_class and bool(c.get("by_class")) for c in release.cohorts}
    rows, stats = _rounds(spark, effective, groups, decoder, service or Service(), rows_per_call, edges, split)
    return rows.withColumnRenamed("_group", "_cohort"), stats


def generate_by_cell(spark: SparkSession, schema: PublicSchema, release: Release, n: int, decoder: Callable[[str], str | Answer], level: int = 0, allow_low_coverage: bool = False, rows_per_call: int = ROWS_PER_CALL, seed: int = 0, service: Service | None = None) -> tuple[DataFrame, GenerationStats]:
    """(row_id, _cell, columns): rows of one released cell after the other; each batch states its number of positives."""
    release.belongs_to(schema)
    if not release.conditional_levels:
        raise GenerationError("the release has no conditional level")
    found = release.conditional_levels[min(level, len(release.conditional_levels) - 1)]
    check_coverage(schema, release, release.conditional_levels.index(found), allow_low_coverage)
    effective, cells, rng = release.effective_schema(schema), found["cells"], random.Random(seed)
    if not cells:
        raise GenerationError("the released level has no cells")

    def group(name: str, want: int) -> Group:
        def write(size: int, spoken: dict) -> tuple[str, dict]:
            positive = quota.positives(cells[name]["rate"], size, rng.random())
            text = cell_prompt(effective, release, name, list(found["columns"]), size, positive)
            return text, {"outcome": {str(schema.positive): positive, str(schema.negative): size - positive}, "columns": {}}

        return Group(name, want, write)

    wanted = zip(cells, quota.apportion([c["support"] for c in cells.values()], n), strict=True)
    groups = [group(name, want) for name, want in wanted if want > 0]
    edges = {c: effective.edges(c) for c in effective.numerical}
    rows, stats = _rounds(spark, effective, groups, decoder, service or Service(), rows_per_call, dict.fromkeys(cells, edges), dict.fromkeys(cells, False))
    if n < quota.LEAST_PER_CELL * len(cells):
        stats.warnings.append(f"{n} rows over {len(cells)} cells: ask for {quota.LEAST_PER_CELL * len(cells)} or more, or take a coarser level")
    return rows.withColumnRenamed("_group", "_cell"), stats


def generate_selected(spark: SparkSession, schema: PublicSchema, release: Release, n: int, decoder: Callable[[str], str | Answer] | None = None, pool_factor: int = POOL_FACTOR, seed: int = 0, sub_bin: str = "release", service: Service | None = None) -> tuple[DataFrame, GenerationStats]:
    """``n`` rows that match the release, out of a pool ``pool_factor`` times as large; without a decoder the pool is the statistical one.

    Where the budget ended before there were ``n`` rows, these are returned as they are.
    """
    if pool_factor < 1:
        raise GenerationError("the pool can't be smaller than what is taken from it")
    if sub_bin not in SUB_BINS:
        raise GenerationError(f"sub_bin must be one of {', '.join(SUB_BINS)}")
    if decoder is None:
        pool, stats = statistical(spark, schema, release, pool_factor * n, seed), GenerationStats(pool_factor * n, rows_kept=pool_factor * n)
    else:
        pool, stats = generate(spark, schema, release, pool_factor * n, decoder, seed=seed, service=service)
    if pool_factor == 1 or (stats.budget_capped and stats.rows_kept < n):
        return (sub_bin_redraw(release.effective_schema(schema), release, pool, "row_id", seed) if sub_bin == "release" else pool), stats
    return select_to_release(schema, release, pool, n, "row_id", allow_short_pool=stats.budget_capped, sub_bin=sub_bin, seed=seed), stats
