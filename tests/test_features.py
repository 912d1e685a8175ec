"""Literal cases of every feature set and a brute-force comparison on random rows."""

import math
import random

import pytest

from priorwake.contracts import Roles
from priorwake.operators import features as feat

CARD = {"card1": 100.0, "card2": 1.0, "card3": 150.0, "card4": "visa", "card5": 200.0, "card6": "credit"}
SCHEMA = "TransactionID long, TransactionDT {time}, card1 double, card2 double, card3 double, card4 string, card5 double, card6 string, addr1 double, DeviceInfo string, ProductCD string, TransactionAmt double"
NAMES = ["TransactionID", "TransactionDT", "card1", "card2", "card3", "card4", "card5", "card6", "addr1", "DeviceInfo", "ProductCD", "TransactionAmt"]


def events(spark, rows, time="long"):
    base = {**CARD, "addr1": 10.0, "DeviceInfo": "device-a", "ProductCD": "H", "TransactionAmt": 10.0}
    full = [{**base, "TransactionID": i + 1, **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([[r[c] for c in NAMES] for r in full], SCHEMA.format(time=time))


def by_id(df):
    return {r["TransactionID"]: r.asDict() for r in df.collect()}


def test_repeated_address(spark):
    out = by_id(feat.address_features(events(spark, [{"TransactionDT": 100 * i, "TransactionAmt": 10.0 * i} for i in (1, 2, 3, 4)])))
    assert [out[4][f"tb_addr_{c}"] for c in ("prior_count", "amt_mean", "amt_std", "recency", "amt_zscore")] == [3, 20, 10, 100, 2]
    assert [out[1][f"tb_addr_{c}"] for c in ("prior_count", "amt_mean", "amt_std", "recency", "amt_zscore")] == [0, None, 0, None, 0]


def test_same_time_and_null_keys(spark):
    rows = [{"TransactionDT": t, "TransactionAmt": a} for t, a in ((100, 50.0), (100, 55.0), (101, 60.0))]
    out = by_id(feat.address_features(events(spark, rows)))
    assert out[1]["tb_addr_prior_count"] == out[2]["tb_addr_prior_count"] == 0
    assert out[3]["tb_addr_amt_mean"] == 52.5 and out[3]["tb_addr_amt_std"] == pytest.approx(math.sqrt(12.5))
    out = by_id(feat.address_features(events(spark, [{**r, "addr1": None} for r in rows])))
    assert all(r["tb_addr_prior_count"] == 0 and r["tb_addr_amt_mean"] is None for r in out.values())


def test_card_key_ignores_address(spark):
    df = events(spark, [{"TransactionDT": 1, "addr1": 1.0}, {"TransactionDT": 2, "addr1": None}])
    assert by_id(feat.card_uid_features(df))[2]["tb_uid_prior_count"] == 1
    assert by_id(feat.uid_features(df))[2]["tb_uid_prior_count"] == 0


def test_later_rows_change_nothing(spark):
    rows = [{"TransactionDT": 1}, {"TransactionDT": 2}, {"TransactionDT": 3}]
    for build, _ in feat.SETS.values():
        short, long = by_id(build(events(spark, rows[:2]))), by_id(build(events(spark, rows)))
        assert all(short[i] == long[i] for i in short)


def test_continues_over_partitions(spark):
    df = events(spark, [{"TransactionDT": 11_059_199}, {"TransactionDT": 11_059_200}, {"TransactionDT": 11_059_200}])
    out = by_id(feat.over_history(df.where("TransactionDT < 11059200"), df.where("TransactionDT >= 11059200"), feat.address_features))
    assert out[2]["tb_addr_prior_count"] == out[3]["tb_addr_prior_count"] == 1


def test_entity_dynamics(spark):
    out = by_id(feat.entity_dynamics(events(spark, [{"TransactionDT": t, "TransactionAmt": a, "ProductCD": p} for t, a, p in ((100, 50.0, "H"), (200, 100.0, "J"), (300, 75.0, "H"))])))[3]
    got = [out[f"tb_entity_{c}"] for c in ("prior_count", "amt_mean", "amt_std", "amt_entropy", "txn_velocity", "amt_velocity", "first_seen", "unique_product_count", "amt_trend")]
    assert got == pytest.approx([2, 75, 35.35533906, 0, 864, 64800, 200, 2, 0.5])
    out = by_id(feat.entity_dynamics(events(spark, [{"TransactionDT": i, "TransactionAmt": a} for i, a in enumerate((50.0, 250.0, 450.0, 1.0))])))[4]
    assert out["tb_entity_amt_entropy"] == pytest.approx(math.log2(3)) and out["tb_entity_amt_std"] == pytest.approx(200)
    out = by_id(feat.entity_dynamics(events(spark, [{"TransactionDT": 100, "TransactionAmt": a} for a in (1.0, 2.0)] + [{"TransactionDT": 101}])))[3]
    assert out["tb_entity_amt_trend"] == 0


def test_pair_strength(spark):
    out = by_id(feat.pair_strength(events(spark, [{"TransactionDT": 100 * i, "DeviceInfo": d} for i, d in enumerate(("dev1", "dev2", "dev1", "dev1"), 1)])))[4]
    assert (out["tb_graph_card_device_count"], out["tb_graph_card_device_recency"], out["tb_graph_card_device_strength"]) == (2, 100, pytest.approx(2 / 3))
    far = by_id(feat.pair_strength(events(spark, [{"TransactionDT": 0}, {"TransactionDT": 30 * 86400}, {"TransactionDT": 60 * 86400 + 1}])))
    assert far[2]["tb_graph_card_device_recency"] == 30 * 86400 and far[3]["tb_graph_card_device_recency"] is None


def test_graph(spark):
    out = by_id(feat.graph_features(events(spark, [{"TransactionDT": t, "addr1": a} for t, a in ((100, 10.0), (100, 10.0), (101, 20.0))])))[3]
    names = ("card_transaction_count", "device_transaction_count", "card_distinct_devices", "card_distinct_addresses", "shared_entity_connectivity")
    assert [out[f"graph_prior_{c}"] for c in names] == [2, 2, 1, 1, 1]
    missing = by_id(feat.graph_features(events(spark, [{"TransactionDT": 1, "DeviceInfo": None}])))[1]
    assert missing["graph_prior_device_transaction_count"] is None and missing["graph_prior_device_distinct_cards"] is None
    late = by_id(feat.graph_features(events(spark, [{"TransactionDT": 100_000}, {"TransactionDT": 11_059_200}, {"TransactionDT": 11_059_200, "addr1": 20.0}])))
    assert (late[2]["graph_prior_shared_entity_connectivity"], late[3]["graph_prior_shared_entity_connectivity"]) == (3, 1)


def test_relations(spark):
    rows = [{"TransactionDT": t, "DeviceInfo": d, "addr1": a} for t, d, a in ((100, "A", 10.0), (100, "B", 20.0), (101, "C", 30.0))]
    out = by_id(feat.relation_features(events(spark, rows)))[3]
    assert (out["tb_card1_device_prior_unique_count"], out["tb_addr1_card1_prior_unique_count"]) == (2, 0)
    for c in ("card1", "DeviceInfo", "addr1"):
        out = by_id(feat.relation_features(events(spark, rows + [{"TransactionDT": 200, c: None}])))[4]
        assert 0.0 in (out["tb_card1_device_prior_unique_count"], out["tb_addr1_card1_prior_unique_count"]) and None not in out.values()


def test_bursts(spark):
    df = events(spark, [{"TransactionDT": t} for t in (8800, 9400, 9999, 10000)])
    assert by_id(feat.behaviour_features(df))[4]["tb_graph_card_velocity"] == 1
    df = events(spark, [{"TransactionDT": t} for t in (9400 - 1e-9, 10000.0)], "double")
    assert by_id(feat.behaviour_features(df))[2]["tb_graph_card_velocity"] == -1


def test_guards(spark):
    df = events(spark, [{"TransactionDT": 1}, {"TransactionDT": 2}])
    with pytest.raises(ValueError, match="missing columns: TransactionAmt, addr1"):
        feat.address_features(df.drop("addr1", "TransactionAmt"))
    with pytest.raises(ValueError, match="not unique"):
        feat.address_features(df.union(df))
    with pytest.raises(ValueError, match="labels"):
        feat.prepare(df, Roles(), ["isFraud"])
    assert feat.specification("graph", feat.graph_features(df)).as_dict()["key"][-1] == "addr1"


@pytest.mark.parametrize("fractional", [False, True])
def test_against_brute_force(spark, fractional):
    rng = random.Random(4)
    rows = []
    for _ in range(300):
        t = rng.choice([rng.randrange(5000), 600 * rng.randrange(9)]) + (30 * 86400 if rng.random() < 0.1 else 0)
        t = t + rng.choice([1e-6, 0.25, 0.5, 0.0]) if fractional else t
        card = rng.choice(["A", "B", None])
        rows.append({"TransactionDT": t, "card4": card, "DeviceInfo": rng.choice(["d1", "d2", "d3", None]), "addr1": rng.choice([1.0, 2.0, None]), "TransactionAmt": round(rng.uniform(0, 2500), 2), "ProductCD": rng.choice(["H", "J", None])})
    df = events(spark, rows, "double" if fractional else "long")
    made = {}
    for build in (feat.card_uid_features, feat.graph_features, feat.behaviour_features):
        for i, r in by_id(build(df)).items():
            made.setdefault(i, {}).update(r)
    for i, r in enumerate(rows, 1):
        past = [p for p in rows if p["TransactionDT"] < r["TransactionDT"]]
        card = [p for p in past if r["card4"] and p["card4"] == r["card4"]]
        pair = [p for p in card if r["DeviceInfo"] and p["DeviceInfo"] == r["DeviceInfo"]]
        place = [p for p in card if r["addr1"] and p["addr1"] == r["addr1"]]
        age = lambda ps, r=r: min((r["TransactionDT"] - p["TransactionDT"] for p in ps), default=None)
        got = made[i]
        assert got["tb_uid_prior_count"] == len(card)
        if card:
            assert got["tb_uid_amt_mean"] == pytest.approx(sum(p["TransactionAmt"] for p in card) / len(card))
        assert got["tb_graph_is_novel_card_device"] == float(not pair)
        recent = age(card)
        assert got["tb_graph_card_recency"] == (pytest.approx(recent) if recent is not None and recent <= 30 * 86400 else None)
        t = r["TransactionDT"]
        exact = sum(t - 600 <= p["TransactionDT"] < t for p in card) - sum(t - 1200 <= p["TransactionDT"] < t - 600 for p in card)
        assert got["tb_graph_card_velocity"] == exact
        assert got["tb_graph_card_device_stability"] == pytest.approx(len(pair) / len(card) if card and r["DeviceInfo"] else 0)
        with_place = [p for p in card if p["addr1"]]
        assert got["tb_graph_card_address_stability"] == pytest.approx(len(place) / len(with_place) if with_place and r["addr1"] else 0)
        assert got["graph_prior_card_distinct_devices"] == (len({p["DeviceInfo"] for p in card} - {None}) if r["card4"] else None)
