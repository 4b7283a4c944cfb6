"""Records of runs: small tables and values, as JSON, Markdown and CSV."""

from __future__ import annotations

import csv
import io
import json
import math
import sys
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, is_dataclass
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from dpspark.errors import Refusal

KIND = "dpspark-result/1"
_refusals: list[type[Exception]] = [Refusal]


def plain(value: Any) -> Any:
    """What JSON can hold: NaN and infinities become null."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set):
        return [plain(v) for v in value]
    if is_dataclass(value) and not isinstance(value, type):
        return plain(asdict(value))
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value if isinstance(value, str | int | float | bool | None) else str(value)


def shown(value: Any) -> str:
    if value is None or isinstance(value, float) and math.isnan(value):
        return "-"
    return f"{value:.3f}" if isinstance(value, float) else str(value)


@dataclass
class ResultTable:
    name: str
    columns: list[str]
    rows: list[list[Any]] = field(default_factory=list)

    @classmethod
    def of(cls, name: str, records: list[dict]) -> ResultTable:
        columns = list(dict.fromkeys(k for r in records for k in r))
        return cls(name, columns, [[r.get(c) for c in columns] for r in records])

    def markdown(self) -> str:
        lines = ["| " + " | ".join(self.columns) + " |", "|" + "-|" * len(self.columns)]
        return "\n".join([*lines, *("| " + " | ".join(map(shown, r)) + " |" for r in self.rows)])

    def csv(self) -> str:
        out = io.StringIO()
        writer = csv.writer(out)
        writer.writerows([self.columns, *([plain(v) for v in r] for r in self.rows)])
        return out.getvalue()

    def frame(self, spark):
        return spark.createDataFrame([tuple(plain(v) for v in r) for r in self.rows], self.columns)


@dataclass
class RunRecord:
    stage: str
    values: dict[str, Any] = field(default_factory=dict)
    tables: list[ResultTable] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    created: str = field(default_factory=lambda: datetime.now(UTC).isoformat())

    def to_json(self) -> str:
        return json.dumps({"kind": KIND} | plain(asdict(self)), indent=1)

    @classmethod
    def from_json(cls, text: str) -> RunRecord:
        body = json.loads(text)
        if body.pop("kind", None) != KIND:
            raise ValueError("not a record of this kind")
        return cls(**body | {"tables": [ResultTable(**t) for t in body["tables"]]})

    def markdown(self) -> str:
        parts = [f"## {self.stage}", *(f"- {k}: {shown(v)}" for k, v in self.values.items()), *(f"- warning: {w}" for w in self.warnings)]
        return "\n".join([*parts, *(f"\n### {t.name}\n\n{t.markdown()}" for t in self.tables)]) + "\n"

    def write(self, folder: str | Path) -> list[Path]:
        """A record as JSON and Markdown, its values and each table as CSV."""
        folder = Path(folder)
        folder.mkdir(parents=True, exist_ok=True)
        values = ResultTable("values", ["name", "value"], [[k, v] for k, v in self.values.items()])
        texts = {f"{self.stage}_record.json": self.to_json(), f"{self.stage}.md": self.markdown(), f"{self.stage}_values.csv": values.csv()}
        texts |= {f"{self.stage}_{t.name}.csv": t.csv() for t in self.tables}
        for name, text in texts.items():
            (folder / name).write_text(text, encoding="utf-8")
        return [folder / n for n in texts]


def of_release(release) -> RunRecord:
    cohorts = [{"cohort": c["cohort_name"], "size": c["cohort_size"], **c["class_balance"], "by_class": "by_class" in c} for c in release.cohorts]
    cells = [{"level": x["level"], "cell": k, **v} for x in release.conditional_levels for k, v in x["cells"].items()]
    values = {"epsilon_budget": release.epsilon_total, "epsilon_accounted": release.audit["epsilon_accounted"], "n_min": release.n_min, "guarantee_void": release.audit["guarantee_void"]}
    return RunRecord("release", values, [ResultTable.of("cohorts", cohorts), ResultTable.of("cells", cells)], release.audit["warnings"])


def of_bound(report) -> RunRecord:
    rows = [{"condition": r.condition, **asdict(c)} for r in (report.synthetic, report.ceiling, report.floor) for c in r.cells]
    rollup = [{"condition": r.condition, **r.rollup()} for r in (report.synthetic, report.ceiling, report.floor)]
    return RunRecord("bound", {"tolerance": report.tolerance, "verdict": report.verdict, "reason": report.reason, **report.claim}, [ResultTable.of("conditions", rollup), ResultTable.of("cells", rows)])


def of_evaluation(result: dict) -> RunRecord:
    rows = [{"table": n, "tv": t["tv"], "absent": len(t["absent"]), **t["auc"]} for n, t in result["tables"].items()]
    rows += [{"table": f"{k} ({s})", **{m: v[s] for m, v in x.items()}} for k, x in result["references"].items() for s in ("mean", "min", "max")]
    panel = [{"table": n, "student": m, **v} for n, p in result["panel"].items() for m, v in p.items()]
    return RunRecord("evaluation", {"n": result["n"]}, [ResultTable.of("scores", rows), ResultTable.of("panel", panel)])


def of_correction(table, gain: dict) -> RunRecord:
    cells = [{"cell": c, "rate": r, "support": table.support[c]} for c, r in table.cells.items()]
    return RunRecord("correction", {"epsilon": table.epsilon, **gain}, [ResultTable.of("cells", cells)], table.audit.get("warnings", []))


def register_refusal(kind: type[Exception]) -> None:
    """Another exception that is told as a refusal."""
    _refusals.append(kind)


def guard(work: Callable[[], None], out=None) -> int:
    """Runs ``work``; a refusal is printed in a box and gives 2, a fault is raised."""
    try:
        work()
    except tuple(_refusals) as e:
        lines = [type(e).__name__, *str(e).splitlines()]
        width = max(map(len, lines))
        print("\n".join(["+" + "-" * (width + 2) + "+", *(f"| {x:{width}} |" for x in lines), "+" + "-" * (width + 2) + "+"]), file=out or sys.stderr)
        return 2
    return 0
