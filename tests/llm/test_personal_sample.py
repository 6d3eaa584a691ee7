import random

from emberwatch.llm import personal
from pyspark.sql import functions as F


def luhn_card(draw):
    digits = [4] + [draw.randrange(10) for _ in range(14)]
    total = sum(d if i % 2 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(digits))
    return "".join(map(str, digits + [-total % 10]))


def planted():
    """Texts with spans the base finds, with ones it misses, and with numbers and names that are neither."""
    draw, texts, missed = random.Random(11), [], {}
    words = "river stone garden window letter market bridge engine paper summer".split()

    def text(*parts):
        return " ".join([*draw.choices(words, k=6), *parts, *draw.choices(words, k=6)])

    def name():
        return f"{draw.choice(words)}.{draw.choice(words)}{draw.randrange(90)}"

    def host():
        return f"{draw.choice(words)}{draw.randrange(9)}.org"

    def phone():
        return f"{draw.randrange(20, 99)} {draw.randrange(100, 999)} {draw.randrange(100, 999)} {draw.randrange(1000, 9999)}"

    for _ in range(250):
        texts += [text("write to", f"{name()}@{host()}"), text("call", f"+{phone()}"), text("card", luhn_card(draw))]
    for _ in range(300):
        texts += [text("order", str(draw.randrange(10**6, 10**8))), text("look [at] the", draw.choice(words)),
                  text(f"look{draw.randrange(50)} [at] {draw.choice(words)}"),
                  text("version", ".".join(str(draw.randrange(100, 999)) for _ in range(3)))]
    for _ in range(40):
        for kind, parts in (
            ("handle", ("write to", f"{name()} [at] {host().replace('.', ' [dot] ')}")),
            ("phone", ("call", phone())), ("card", ("card", f"{luhn_card(draw)} {draw.randrange(10**7, 10**8)}")),
        ):
            missed[len(texts)] = kind
            texts.append(text(*parts))
    return texts, missed


def test_planted_misses_are_found(spark):
    """Nine in ten of each kind that base patterns miss, at a precision of nine in ten."""
    texts, missed = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    added = {r.doc_id for r in personal.find(docs).filter(F.size("added") > 0).collect()}
    for kind in set(missed.values()):
        wanted = {d for d, k in missed.items() if k == kind}
        assert len(added & wanted) >= 0.9 * len(wanted), kind
    assert len(added & set(missed)) >= 0.9 * len(added)


def test_rare_kinds_fill_their_own_share():
    drawn = personal.shares({"digits": 60_000, "number": 400, "handle": 900}, 2000)
    assert drawn["number"] == 1 and abs(drawn["handle"] * 900 - 800) < 1
    assert abs(drawn["digits"] * 60_000 - 800) < 1


def test_made_positives_stand_where_the_span_stood(spark):
    docs = spark.createDataFrame([
        (1, "please write ana.b@post.org today"), (2, "call +49 30 1234 5678 at noon"), (3, None),
        (4, "card 4111 1111 1111 1111 expires"), (5, "no data here"),
    ], "doc_id long, text string")
    rows = personal.candidates(docs)
    made = personal.made_positives(rows).collect()
    assert {r.kind for r in made} >= {"handle", "number"} and not any(r.near_base for r in made)
    assert rows.select(F.inline("shown")).count() == 3
    # Forms of an address, of a phone number and of a card give candidates of their kinds.
    ids = {r["_row"]: r["_key"] for r in rows.select("_row", "_key").collect()}
    assert {ids[r["_row"]] for r in made} == {1, 2, 4}


def test_long_number_runs_are_candidates_in_pieces(spark):
    text = "call " + " ".join(["4845 1681 1440 7328"] * 6)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = [x for x in personal.candidates(docs).first().loose if x.kind == "number"]
    assert found and all(x.end - x.start <= 64 and text[x.end - 1].isdigit() for x in found)
    for k in range(6):
        low = 5 + 20 * k
        assert any(x.start <= low and low + 19 <= x.end for x in found)


def test_every_span_and_candidate_is_learned_from(spark):
    """More spans of a kind, and more candidates, than any sample took."""
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("write to name"), "id", F.lit("@post.org "))).otherwise(""),
        F.lit("order "), F.col("id") + 10**7, F.lit(" and order "), F.col("id") + 3 * 10**8).alias("text"))
    rows = personal.candidates(docs)
    made = personal.made_positives(rows)
    forms = made.groupBy("form").agg(F.countDistinct("_row").alias("n")).collect()
    assert {r.form: r.n for r in forms} == {f"email {i}": 4000 for i in range(3)}
    loose = rows.select("_row", "_half", F.inline("loose")).filter(~F.col("near_base"))
    assert loose.count() > 40_000
    learned = personal.cells(loose, made).groupBy("label").agg(F.sum("n").alias("n")).collect()
    assert {r.label: r.n for r in learned} == {0.0: loose.count(), 1.0: made.count()}


def test_splits_need_no_sample(spark):
    """Every feature has two values, for which Spark looks at no rows to choose splits."""
    rows = personal.candidates(spark.createDataFrame([(1, "order 12345678")], "doc_id long, text string"))
    out = personal.assembled(rows.select(F.inline("loose")))
    told = out.schema["_features"].metadata["ml_attr"]
    assert set(told["attrs"]) == {"binary"} and len(told["attrs"]["binary"]) == told["num_attrs"]
    assert set(personal.CUTS) == {*personal.FORMAT, *personal.CONTEXT}
