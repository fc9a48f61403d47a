"""Landed pages, candles, payloads, registrations."""

import json

import pytest
from pyspark.sql import functions as F

from barwright.operators import replication
from barwright.operators.gates import Registration
from barwright.plans import hypotheses
from barwright.sources import paged, publish, readers
from barwright.sources.registry import DATASETS


def _answer(page, flag, output, name="tr_cont", **body):
    return json.dumps({"page": page, "status": 200, "headers": {name: flag}, "body": {"rt_cd": "0", "output": output, **body}})


def _landed(tmp_path, chains):
    for chain, files in chains.items():
        folder = tmp_path / paged.folder_of(chain)
        folder.mkdir(parents=True)
        (folder / "_SUCCESS").write_text("")
        for i, lines in enumerate(files):
            (folder / f"part-{i}.txt").write_text("\n".join(lines) + "\n")
    return str(tmp_path)


def test_pages_are_followed_to_the_end(spark, tmp_path):
    r = lambda *ks: [{"k": k} for k in ks]
    path = _landed(
        tmp_path,
        {
            "a/b=1": [[_answer(0, "M", r(1, 2)), _answer(1, " F ", {"k": 3}, "TR_CONT")], [_answer(2, "M", None), _answer(3, "D", [4, None, {"k": 5}], msg="x"), _answer(9, "M", r(6))]],
            "one page": [[_answer(0, "", r(7), output2={"s": 1})]],
            "none": [[]],
        },
    )
    df = paged.landed_pages(spark, path)
    got = lambda d: sorted((x.chain, x.page, x.output, x.n, json.loads(x.record)) for x in d.collect())
    a = [("a/b=1", 0, "output", 0, {"k": 1}), ("a/b=1", 0, "output", 1, {"k": 2}), ("a/b=1", 1, "output", 0, {"k": 3}), ("a/b=1", 3, "output", 0, {"k": 5})]
    one = [("one page", 0, "output", 0, {"k": 7}), ("one page", 0, "output2", 0, {"s": 1})]
    assert got(df) == a + one
    assert got(df.where("output = 'output2'")) == one[1:]
    assert got(df.where("chain in ('a/b=1', 'absent')")) == a
    assert got(df.where("chain = 'a/b=1' AND page > 0")) == a[2:]
    assert got(paged.landed_pages(spark, path, pages=1)) == a[:2] + one
    assert df.where("chain = 'absent'").count() == 0


def test_filters_open_only_their_chains(spark, tmp_path):
    path = _landed(tmp_path, {"good": [[_answer(0, "D", [{"k": 1}])]], "bad": [["{no JSON"]]})
    assert paged.landed_pages(spark, path).where("chain = 'good'").count() == 1
    with pytest.raises(Exception, match="Expecting property name"):
        paged.landed_pages(spark, path).count()


@pytest.mark.parametrize(
    ("lines", "said"),
    [
        ([_answer(0, "M", [])], "page 1 is missing"),
        ([_answer(0, "M", []), _answer(2, "D", [])], "page 2 where 1 follows"),
        ([_answer(0, "D", [], rt_cd="1", msg_cd="E9", msg1="too often")], "E9 too often"),
        (['{"page": 0, "status": 500, "headers": null, "body": "down"}'], "no reason given"),
    ],
)
def test_broken_chains_fail(spark, tmp_path, lines, said):
    path = _landed(tmp_path, {"c": [lines]})
    with pytest.raises(Exception, match=said):
        paged.landed_pages(spark, path).collect()


def test_landing_round_trip(spark, tmp_path):
    body = F.concat(F.lit('{"rt_cd":"0","output":'), F.to_json(F.struct(F.col("id").cast("string").alias("stck_clpr"))), F.lit("}"))
    flag = F.when(F.col("id") % 10 == 9, "D").otherwise("M")
    rows = spark.range(100).select(F.concat(F.lit("c: "), F.floor(F.col("id") / 10).cast("string"), F.lit("%")).alias("chain"), (F.col("id") % 10).cast("int").alias("page"), paged.answer(F.col("id") % 10, flag, body).alias("line"))
    paged.land(rows, f"{tmp_path}/x")
    got = paged.dataset_records(paged.landed_pages(spark, f"file://{tmp_path}/x"), DATASETS["price_daily"], "output")
    assert sorted((r.chain, r._seq.page, int(r.stck_clpr)) for r in got.collect()) == [(f"c: {i // 10}%", i % 10, i) for i in range(100)]


def _candles(spark, *rows):
    names = ["localDate", "openPrice", "highPrice", "lowPrice", "closePrice", "accumulatedTradingVolume"]
    return spark.createDataFrame([("t", json.dumps({"priceInfos": [dict(zip(names, r)) for r in rows]}))], "ticker string, body string")


def test_candles(spark):
    some = readers.candles(_candles(spark, ("20200102", 1, 2, 1, 2, None), ("20200103", 2, 3, 1, 3, 10)), "body")
    assert some.columns == ["ticker", "date", "open", "high", "low", "close", "volume"] and [r.volume for r in some.orderBy("date").collect()] == [None, 10.0]
    assert "volume" not in readers.candles(_candles(spark, ("20200102", 1, 2, 1, 2)), "body").columns
    with pytest.raises(ValueError, match="no candles"):
        readers.candles(_candles(spark), "body")
    for bad in (("20200102", 1, 2, 3, 2, 1), ("20200102", 0, 2, 0, 2, 1), ("20200102", 1, 2, 1, None, 1)):
        with pytest.raises(ValueError, match="invalid"):
            readers.candles(_candles(spark, bad), "body")


def test_payload(spark):
    rows = spark.createDataFrame([("a", 1, 1.5), ("a", 2, float("inf")), ("a", 3, float("nan")), ("b", 1, None)], "ticker string, day int, x double")
    few = spark.createDataFrame([("b", 4, 2.0)], "ticker string, day int, x double")
    blocks = [publish.block(rows, "newest", "ticker", "day", ["x"], single=True), publish.block(rows, "two", "ticker", "day", ["day", "x"], 2), publish.block(few, "few", "ticker", "day", ["x"])]
    got = {r.ticker: json.loads(r.payload) for r in publish.payload(blocks, "ticker", {"kind": F.lit("k")}).collect()}
    assert got["a"] == {"kind": "k", "newest": {"x": None}, "two": [{"day": 2, "x": None}, {"day": 3, "x": None}], "few": None}
    assert got["b"] == {"kind": "k", "newest": {"x": None}, "two": [{"day": 1, "x": None}], "few": [{"x": 2.0}]}
    with pytest.raises(ValueError):
        publish.block(rows, "none", "ticker", "day", ["x"], 0)


def test_registration(spark, monkeypatch):
    whole = dict(data="x", kind="real", research_end="1997-12-31", validation_end="1999-12-31", most_drawdown=0.9)
    assert Registration(**whole).lacks() == ""
    monkeypatch.setattr(hypotheses, "trades", lambda *_: pytest.fail("rows were read"))
    for change in ({"data": None}, {"kind": "synthetic"}, {"research_end": None}, {"validation_end": ""}, {"validation_end": "1997-12-31"}, {"most_drawdown": None}, {"most_drawdown": 1.0}, {"most_drawdown": 0.0}):
        out = hypotheses.decision(spark, "nowhere", Registration(**{**whole, **change})).collect()
        assert {r.status for r in out} == {"NOT_READY"} and len(out) == len(hypotheses.HYPOTHESES) and all(r.waits for r in out)


def test_replication_equals_a_loop(spark):
    opens, own, pos = [1.0, 1.1, 1.0, 1.2, 1.3, 1.2], [2.0, 2.2, 2.1, 2.0, 2.4, 2.5], [0, 1, 1, 0, 1, 1]
    rows = [("t", f"2020-{1 + i // 3:02d}-0{1 + i % 3}", opens[i], pos[i], own[i], 1 - pos[i]) for i in range(6)]
    df = spark.createDataFrame(rows, "ticker string, date string, index_open double, index_position int, open double, position int").withColumn("date", F.col("date").cast("date"))
    weight, net, value, paid, worst, turned = 0.0, [], 0.0, 0.0, 0.0, 0
    for i in range(6):
        w = float(pos[i - 1]) if 0 < i < 5 else 0.0
        net.append(w * (own[i + 1] / own[i] - 1) - abs(w - weight) * 0.001 / 2 if i < 5 else 0.0)
        turned += i > 0 and w != weight
        weight = w
        if i in (0, 3):
            value, paid = value + 100, paid + 100
        value *= 1 + net[-1]
        worst = max(worst, (paid - value) / paid)
    total = 1.0
    for r in net:
        total *= 1 + r
    run = [("own_by_index", 10.0)]
    s = replication.summaries(df, run).first()
    assert s.total == pytest.approx((total - 1) * 100) and s.switches == turned and s.n == 6
    c = replication.contributed(df, run, 100).first()
    assert (c.value, c.paid_in, c.deepest_loss) == pytest.approx((value, paid, worst * 100))
    y = replication.by_year(df, run, 6).first()
    assert (y.year, y.days, y.total) == (2020, 6, pytest.approx((total - 1) * 100)) and not replication.by_year(df, run, 7).count()


def test_short_chains_share_a_task(spark, tmp_path):
    """Tasks follow the bytes of the chains, not their number; each chain is read as by itself."""
    for k in range(300):
        folder = tmp_path / f"chain=c{k}"
        folder.mkdir()
        folder.joinpath("part-0.txt").write_text("".join(json.dumps({"page": p, "headers": {"tr_cont": "M" if p < 2 else "D"}, "body": {"rt_cd": "0", "output": [{"x": k}, {"x": p}]}}) + "\n" for p in range(4)))
    every = paged.landed_pages(spark, f"file://{tmp_path}")
    assert every.rdd.getNumPartitions() < 10
    assert sorted(tuple(r) for r in every.groupBy("chain").count().collect()) == sorted((f"c{k}", 6) for k in range(300))
    assert {(r.chain, r.page) for r in every.where("chain IN ('c7', 'c250', 'none')").collect()} == {(c, p) for c in ("c7", "c250") for p in range(3)}
