from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest

from dpspark import models, report
from dpspark.__main__ import main
from dpspark.errors import ModelCapabilityError, ModelRefusalError, PromptIntegrityError, RateLimitedError, Refusal
from dpspark.plans import generate
from dpspark.sources.tables import read_table
from tests.test_engine import demo


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    rng = np.random.default_rng(5)
    n = 6000
    edu = rng.choice(["HS", "College", "Grad"], n)
    df = pd.DataFrame({"age": rng.uniform(18, 90, n).round(2), "edu": edu, "result": rng.choice(["None", "High"], n), "y": np.where(rng.random(n) < np.where(edu == "Grad", 0.6, 0.2), "YES", "NO")})
    df.to_csv(folder / "private.csv", index=False)
    df.assign(y=rng.permutation(df["y"])).to_csv(folder / "flat.csv", index=False)
    (folder / "schema.json").write_text(demo().to_json())
    return folder


def test_none_is_a_value(spark, files):
    df = read_table(spark, str(files / "private.csv"), demo().columns)
    assert {r["result"] for r in df.select("result").distinct().collect()} == {"None", "High"}
    with pytest.raises(Refusal):
        read_table(spark, str(files / "private.csv"), ["nothing"])


def test_run(spark, files, capsys):
    out = files / "out"
    assert main(["run", "--schema", str(files / "schema.json"), "--private", str(files / "private.csv"), "--out", str(out), "--rows", "300", "--epsilon", "8", "--seed", "1", "--reference-draws", "1", "--students", "LR"]) == 0
    for name in ("release.json", "release.md", "release_cohorts.csv", "bound_report.json", "bound_record.json", "evaluation_record.json", "evaluation_panel.csv"):
        assert (out / name).exists()
    assert json.loads((out / "release.json").read_text())["audit"]["guarantee_void"]
    assert 280 <= read_table(spark, str(out / "synthetic.csv"), demo().columns).count() <= 300
    assert main(["release", "--schema", str(files / "schema.json"), "--private", str(files / "private.csv"), "--out", str(out), "--n-min", "10"]) == 2
    assert "ReleaseError" in capsys.readouterr().err


def test_correct(spark, files):
    out = files / "fixed"
    assert main(["correct", "--schema", str(files / "schema.json"), "--private", str(files / "private.csv"), "--synthetic", str(files / "flat.csv"), "--columns", "edu", "--out", str(out), "--epsilon", "8"]) == 0
    record = report.RunRecord.from_json((out / "correction_record.json").read_text())
    assert record.values["worth_it"] and record.to_json() == report.RunRecord.from_json(record.to_json()).to_json()


def test_models():
    table = models.ModelTable()
    table.register("small", models.INSUFFICIENT)
    table.register("small-but-good", models.VALIDATED, 1.0, 2.0)
    assert table.check("small-but-good-2").tier == models.VALIDATED and table.validated() == ["small-but-good"]
    for name in ("small-1", "other"):
        with pytest.raises(ModelCapabilityError):
            table.check(name)
    meter = models.SpendMeter(table, "small-but-good", 1.0)
    assert meter.add(100_000, 100_000) and not meter.add(500_000, 500_000)
    assert models.fits_context("x" * 350, 100, 200) and not models.fits_context("x" * 351, 100, 200)


def test_templates_are_locked(monkeypatch):
    with pytest.raises(PromptIntegrityError):
        generate.register_template("bad", "no fields")
    text, digest = generate._templates["rows"]
    monkeypatch.setitem(generate._templates, "rows", (text + " changed", digest))
    with pytest.raises(PromptIntegrityError):
        generate.template("rows")


def test_waiting():
    waits, calls = [], iter([RateLimitedError(), RateLimitedError(), "done"])

    def decoder(text: str) -> str:
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert generate.ask(decoder, "", waits.append) == "done" and waits == [15, 30]

    def refuse(text: str) -> str:
        raise ModelRefusalError

    with pytest.raises(ModelRefusalError):
        generate.ask(refuse, "", waits.append)
    assert waits == [15, 30]


DECODER = '''
import re

def rows(text):
    n = int(re.search(r"Write (\\d+) rows", text)[1])
    found = re.search(r"(?:outcome: .*?YES x (\\d+))|(?:exactly (\\d+) x YES)", text)
    p = int(found[1] or found[2])
    group = text.split("roup:")[1].splitlines()[0]
    edu = next((e for e in ("College", "HS", "Grad") if e in group), "Grad")
    return "age,edu,result,y\\n" + "\\n".join(f"{20 + i % 60},{edu},None,{'YES' if i < p else 'NO'}" for i in range(n))
'''


def test_a_decoder_on_the_command_line(spark, files, capsys):
    """Rows of a pool, of cohorts and of cells by a function in a file, within a budget; and what is refused."""
    (files / "decoder.py").write_text(DECODER)
    (files / "models.json").write_text(json.dumps({"mine": ["VALIDATED", 1.0, 1.0], "weak": ["INSUFFICIENT"]}))
    given = ["--schema", str(files / "schema.json"), "--private", str(files / "private.csv")]
    first = files / "first"
    assert main(["release", *given, "--out", str(first), "--epsilon", "8", "--seed", "1"]) == 0
    common = ["generate", "--schema", str(files / "schema.json"), "--release", str(first / "release.json"), "--rows", "60"]
    decoder = ["--decoder", f"{files / 'decoder.py'}:rows", "--model", "mine-1", "--models", str(files / "models.json")]
    for how in ("selected", "cohort", "cell"):
        out = files / how
        assert main([*common, *decoder, "--how", how, "--out", str(out), "--allow-low-coverage", "--sub-bin", "generator", "--budget-usd", "5"]) == 0, capsys.readouterr().err
        rows = read_table(spark, str(out / "synthetic.csv"), demo().columns).toPandas()
        stats = json.loads((out / "generation.json").read_text())
        assert set(rows["edu"]) <= {"College", "HS", "Grad"} and stats["calls"] > 0 and stats["cost_usd"] > 0 and abs(len(rows) - 60) <= 1
    for bad, said in (
        (["--decoder", "nowhere"], "module:function"), (["--decoder", "no.such.module:f"], "can't be loaded"), (["--decoder", f"{files / 'decoder.py'}:other"], "no function"),
        (["--how", "cell"], "name a --decoder"), ([*decoder, "--model", "weak-2"], "INSUFFICIENT"), (["--decoder", f"{files / 'decoder.py'}:rows", "--budget-usd", "1"], "prices"),
    ):
        assert main([*common, *bad, "--out", str(files / "bad")]) == 2 and said in capsys.readouterr().err
