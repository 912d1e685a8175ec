"""Strict-prior feature sets of events, entities and entity pairs.

Each builder takes events and Roles, adds its columns in place and selects (id, features). prepare() projects and checks
first. All sets keep their own namespace: several of them use the same feature names for different keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from priorwake.contracts import DAY, Roles, Specification, refuse_labels, require_columns, require_events
from priorwake.functions import amount_bin, composite_key

from .history import History

MONTH = 30 * DAY
BURST = 600


def prepare(df: DataFrame, roles: Roles, columns, *, check: bool = True) -> DataFrame:
    """The id, the time and the given columns of df; raises on missing or label columns, repeated ids, null times."""
    names = list(dict.fromkeys([roles.id, roles.time, *columns]))
    refuse_labels(names)
    require_columns(df, names)
    out = df.select(*names)
    if check:
        never = [roles.time, *[c for c in (roles.amount,) if c in names]]
        require_events(out, roles.id, *never)
    return out


def _zero(c: Column) -> Column:
    return c.cast("double")


def amount_history(df: DataFrame, roles: Roles, key: tuple[str, ...], prefix: str, *, check: bool = True) -> DataFrame:
    """{prefix}_prior_count, _amt_mean, _amt_std, _recency, _amt_zscore of a composite key."""
    df = prepare(df, roles, [*key, roles.amount], check=check).withColumn("_key", composite_key(key))
    h = History(df, "_key", roles.time, roles.id)
    amount = roles.amount
    return h.df.select(
        roles.id,
        _zero(h.count()).alias(f"{prefix}_prior_count"),
        h.mean(amount).alias(f"{prefix}_amt_mean"),
        h.std(amount).alias(f"{prefix}_amt_std"),
        h.recency().cast("double").alias(f"{prefix}_recency"),
        h.zscore(amount).alias(f"{prefix}_amt_zscore"),
    )


def address_features(df: DataFrame, roles: Roles = Roles(), **how) -> DataFrame:
    return amount_history(df, roles, (roles.address,), "tb_addr", **how)


def uid_features(df: DataFrame, roles: Roles = Roles(), **how) -> DataFrame:
    return amount_history(df, roles, roles.entity, "tb_uid", **how)


def card_uid_features(df: DataFrame, roles: Roles = Roles(), **how) -> DataFrame:
    """The names of uid_features, keyed by the card alone."""
    return amount_history(df, roles, roles.card, "tb_uid", **how)


def _entity(df: DataFrame, roles: Roles, check: bool) -> History:
    df = prepare(df, roles, [*roles.entity, roles.amount, roles.category], check=check)
    df = df.withColumn("_key", composite_key(roles.entity)).withColumn("_category", F.coalesce(F.col(roles.category).cast("string"), F.lit("None")))
    h = History(df, "_key", roles.time, roles.id)
    h.df = h.df.withColumn("_first", h.firsts("_category"))
    return h


def entity_features(df: DataFrame, roles: Roles = Roles(), *, check: bool = True) -> DataFrame:
    """History of the card and address together. A null category counts as the value None."""
    h = _entity(df, roles, check)
    amount = roles.amount
    return h.df.select(
        roles.id,
        _zero(h.count()).alias("tb_entity_prior_count"),
        _zero(h.age()).alias("tb_entity_first_seen_age"),
        h.recency().cast("double").alias("tb_entity_recency"),
        h.mean(amount).alias("tb_entity_amt_mean"),
        h.std(amount).alias("tb_entity_amt_std"),
        h.zscore(amount).alias("tb_entity_amt_zscore"),
        _zero(h.distinct("_first")).alias("tb_entity_unique_product_count"),
    )


def entity_dynamics(df: DataFrame, roles: Roles = Roles(), *, check: bool = True) -> DataFrame:
    """Rates, spread and trend of the amounts of the card and address together."""
    h = _entity(df, roles, check)
    amount = roles.amount
    h.df = h.df.withColumn("_bin", amount_bin(F.col(amount))).withColumn("_days", h.age() / F.lit(float(DAY)))
    days = F.col("_days")
    per_day = lambda c: F.when(days > 0, c / days).otherwise(F.lit(0.0))
    return h.df.select(
        roles.id,
        _zero(h.count()).alias("tb_entity_prior_count"),
        h.mean(amount).alias("tb_entity_amt_mean"),
        h.std(amount).alias("tb_entity_amt_std"),
        h.entropy("_bin").alias("tb_entity_amt_entropy"),
        per_day(h.count()).alias("tb_entity_txn_velocity"),
        per_day(h.sum(amount)).alias("tb_entity_amt_velocity"),
        _zero(h.age()).alias("tb_entity_first_seen"),
        _zero(h.distinct("_first")).alias("tb_entity_unique_product_count"),
        h.slope(amount, roles.time).alias("tb_entity_amt_trend"),
    )


def _nodes(df: DataFrame, roles: Roles, extra=(), *, check: bool) -> DataFrame:
    df = prepare(df, roles, [*roles.card, roles.device, roles.address, *extra], check=check)
    df = df.select(
        roles.id,
        roles.time,
        composite_key(roles.card).alias("_card"),
        F.col(roles.device).cast("string").alias("_device"),
        F.col(roles.address).cast("string").alias("_address"),
        *extra,
    )
    return df.withColumns({"_cd": composite_key(["_card", "_device"], "\x1f"), "_ca": composite_key(["_card", "_address"], "\x1f"), "_da": composite_key(["_device", "_address"], "\x1f")})


def _of(df: DataFrame, roles: Roles, key: str) -> History:
    return History(df, key, roles.time, roles.id)


def pair_strength(df: DataFrame, roles: Roles = Roles(), *, check: bool = True) -> DataFrame:
    """How often, how lately and for what share of its rows a card was seen with this device."""
    card = _of(_nodes(df, roles, check=check), roles, "_card")
    pair = _of(card.df, roles, "_cd")
    n = pair.count()
    return pair.df.select(
        roles.id,
        _zero(n).alias("tb_graph_card_device_count"),
        pair.recency(MONTH).cast("double").alias("tb_graph_card_device_recency"),
        F.when(card.count() > 0, n / F.when(card.count() > 0, card.count())).otherwise(F.lit(0.0)).alias("tb_graph_card_device_strength"),
    )


def graph_features(df: DataFrame, roles: Roles = Roles(), *, check: bool = True) -> DataFrame:
    """Degrees of card, device and address and the edges between them that existed before; null for a missing node."""
    df = _nodes(df, roles, check=check)
    nodes: dict[str, History] = {}
    for k in ("_card", "_device", "_address", "_cd", "_ca", "_da"):
        nodes[k] = _of(df, roles, k)
        df = nodes[k].df  # with its rank column, if times are fractional
    card, device, address, *pairs = nodes.values()
    df = df.withColumns({"_f_cd": card.firsts("_device"), "_f_dc": device.firsts("_card"), "_f_ca": card.firsts("_address"), "_f_ac": address.firsts("_card")})
    edge = lambda h: F.when(h.count() > 0, F.lit(1)).otherwise(F.lit(0))
    some = pairs[0].known | pairs[1].known | pairs[2].known
    gated = lambda h, c: F.when(h.known, c.cast("long"))
    return df.select(
        roles.id,
        gated(card, card.count()).alias("graph_prior_card_transaction_count"),
        gated(device, device.count()).alias("graph_prior_device_transaction_count"),
        gated(address, address.count()).alias("graph_prior_address_transaction_count"),
        gated(card, card.distinct("_f_cd")).alias("graph_prior_card_distinct_devices"),
        gated(device, device.distinct("_f_dc")).alias("graph_prior_device_distinct_cards"),
        gated(card, card.distinct("_f_ca")).alias("graph_prior_card_distinct_addresses"),
        gated(address, address.distinct("_f_ac")).alias("graph_prior_address_distinct_cards"),
        F.when(some, edge(pairs[0]) + edge(pairs[1]) + edge(pairs[2])).cast("long").alias("graph_prior_shared_entity_connectivity"),
    )


def relation_features(df: DataFrame, roles: Roles = Roles(), *, card: str = "card1", check: bool = True) -> DataFrame:
    """Distinct devices of one card column and distinct cards of an address; 0 if either end is missing now."""
    df = prepare(df, roles, [card, roles.device, roles.address], check=check)
    df = df.select(roles.id, roles.time, F.col(card).alias("_card"), F.col(roles.device).alias("_device"), F.col(roles.address).alias("_address"))
    c = _of(df, roles, "_card")
    c.df = c.df.withColumn("_f_cd", c.firsts("_device"))
    a = _of(c.df, roles, "_address")
    a.df = a.df.withColumn("_f_ac", a.firsts("_card"))
    gate = lambda other, made: _zero(F.when(F.col(other).isNotNull(), made).otherwise(F.lit(0)))
    return a.df.select(
        roles.id,
        gate("_device", c.distinct("_f_cd")).alias("tb_card1_device_prior_unique_count"),
        gate("_card", a.distinct("_f_ac")).alias("tb_addr1_card1_prior_unique_count"),
    )


def behaviour_features(df: DataFrame, roles: Roles = Roles(), *, burst: int = BURST, horizon: int = MONTH, check: bool = True) -> DataFrame:
    """Recency, bursts, novelty, amounts and stability of cards and of their pairs with devices and addresses."""
    card = _of(_nodes(df, roles, (roles.amount,), check=check), roles, "_card")
    pair = _of(card.df, roles, "_cd")
    place = _of(pair.df, roles, "_ca")
    amount = roles.amount
    share = lambda n, of: F.when(of > 0, n / F.when(of > 0, of)).otherwise(F.lit(0.0))
    return place.df.select(
        roles.id,
        card.recency(horizon).alias("tb_graph_card_recency"),
        _zero(card.burst(burst)).alias("tb_graph_card_velocity"),
        F.when(pair.count() > 0, F.lit(0.0)).otherwise(F.lit(1.0)).alias("tb_graph_is_novel_card_device"),
        card.mean(amount).alias("tb_graph_card_amt_mean"),
        card.zscore(amount).alias("tb_graph_card_amt_zscore"),
        share(pair.count(), card.count()).alias("tb_graph_card_device_stability"),
        pair.recency(horizon).alias("tb_graph_pair_recency"),
        _zero(pair.burst(burst)).alias("tb_graph_pair_velocity"),
        # The denominator is the card's prior rows that have an address.
        share(place.count(), card.count(F.col("_address"))).alias("tb_graph_card_address_stability"),
    )


#: Feature sets by name: builder, key roles, features.
SETS = {
    "address": (address_features, ("address",)),
    "uid": (uid_features, ("card", "address")),
    "uid_card": (card_uid_features, ("card",)),
    "entity": (entity_features, ("card", "address")),
    "entity_dynamics": (entity_dynamics, ("card", "address")),
    "pair_strength": (pair_strength, ("card", "device")),
    "graph": (graph_features, ("card", "device", "address")),
    "relation": (relation_features, ("card", "device", "address")),
    "behaviour": (behaviour_features, ("card", "device", "address")),
}
#: The behaviour features of each ablation.
ABLATIONS = {
    "E1": ("tb_graph_card_recency",),
    "E2": ("tb_graph_card_velocity",),
    "E3": ("tb_graph_is_novel_card_device",),
    "E4": ("tb_graph_card_amt_mean", "tb_graph_card_amt_zscore"),
    "E5": ("tb_graph_card_device_stability",),
}
_ALL_BEHAVIOUR = (
    "tb_graph_card_recency",
    "tb_graph_card_velocity",
    "tb_graph_is_novel_card_device",
    "tb_graph_card_amt_mean",
    "tb_graph_card_amt_zscore",
    "tb_graph_card_device_stability",
    "tb_graph_pair_recency",
    "tb_graph_pair_velocity",
    "tb_graph_card_address_stability",
)
ABLATIONS |= {"E6": _ALL_BEHAVIOUR, "E7": _ALL_BEHAVIOUR}


def ablation(df: DataFrame, experiment: str, roles: Roles = Roles(), **how) -> DataFrame:
    """The behaviour features of one experiment."""
    return behaviour_features(df, roles, **how).select(roles.id, *ABLATIONS[experiment])


def specification(name: str, built: DataFrame, roles: Roles = Roles()) -> Specification:
    _, key = SETS[name]
    columns = [c for role in key for c in (getattr(roles, role) if isinstance(getattr(roles, role), tuple) else (getattr(roles, role),))]
    return Specification(name, tuple(columns), {f.name: f.dataType.simpleString() for f in built.schema if f.name != roles.id})


def attach(df: DataFrame, features: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Features joined back by id."""
    return df.join(features, roles.id, "left")


def over_history(train: DataFrame, later: DataFrame, build, roles: Roles = Roles(), **how) -> DataFrame:
    """Features of two consecutive partitions on one history: earlier rows feed later ones, never the other way."""
    return build(train.unionByName(later), roles, **how)
