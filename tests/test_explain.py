
import pytest

from emberwatch.operators.explain import (
    explain, explain_once, explanation_input, prompt, with_retries,
)
from emberwatch.operators.results import preview_lines, report_table

SHAPE = "event_type string, raw_log string, user string, source_ip string, severity int"


def test_texts(spark):
    events = spark.createDataFrame([("login", "bad password", None, "1.2.3.4", 7)], SHAPE)
    asked = explanation_input(events).select(prompt()).first()[0]
    assert "User: None" in asked and "Message: bad password" in asked and "Severity: 7" in asked
    plain = explain(events).first()
    assert plain.explanation == "login by user None from 1.2.3.4 scored 7: bad password"
    assert plain.status == "explained"
    assert explain(events, lambda prompts: prompts.str.upper()).first().explanation == asked.upper()


def test_preview_pads_and_cuts(spark):
    events = explain(spark.createDataFrame([("login", "x" * 200, "u", "1.2.3.4", 7)], SHAPE))
    line = preview_lines(events).first().line
    assert line.startswith("  [  7] login | 1.2.3.4 | login by user u")
    assert len(line.split(" | ")[2]) == 100


def test_a_prompt_is_asked_once(spark, tmp_path, folder):
    """Over repeats in a batch, later batches and failing calls; every call leaves its prompts."""
    def count(prompts):
        import pathlib
        import uuid

        log = pathlib.Path(str(tmp_path))
        if not (log / "failed").exists():
            (log / "failed").touch()
            raise OSError("busy")
        (log / f"call-{uuid.uuid4().hex}").write_text("\n".join(p.replace("\n", " ") for p in prompts))
        return prompts.str.len().astype(str)

    path = folder("answers")
    rows = [("login", f"log {n % 5}", "u", "1.2.3.4", 7) for n in range(40)]
    first = explain_once(spark.createDataFrame(rows, SHAPE), count, path)
    assert first.count() == 40 and {r.status for r in first.collect()} == {"explained"}
    more = rows + [("login", None, None, None, None), ("login", "log 9", "u", "1.2.3.4", 7)]
    second = explain_once(spark.createDataFrame(more, SHAPE), count, path)
    assert all(r.explanation == str(len(r.asked)) for r in second.select(
        "explanation", prompt("raw_log").alias("asked")).collect())
    asked = [p for call in tmp_path.glob("call-*") for p in call.read_text().splitlines() if p]
    assert len(asked) == len(set(asked)) == 7


def test_a_call_that_keeps_failing_fails(spark):
    calls = []

    def broken(prompts):
        calls.append(1)
        raise OSError("down")

    with pytest.raises(OSError):
        with_retries(broken, 3)(None)
    assert len(calls) == 3


def test_report_has_a_header(spark):
    shape = "alert_id int, level int, source_ip string, destination_ip string, port int, severity int, " \
            "label string, status string"
    rows = spark.createDataFrame([(1, 3, "1.2.3.4", "10.0.0.1", 22, 40, "suspicious", "scored")], shape)
    head, rule, line = [r.line for r in report_table(rows, ("alert_id",)).orderBy("place").collect()]
    for name in ("level", "source_ip", "port", "severity", "label", "status"):
        assert head.index(name) == rule.index("-", head.index(name))
    assert line[head.index("source_ip"):].startswith("1.2.3.4 ")
    assert line[head.index("status"):] == "scored"
