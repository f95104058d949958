"""From payloads to feature vectors, in one projection of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearscore.functions import scalars as S
from nearscore.functions.config import FEATURES, MOST_MERCHANTS, ScoringConfig
from nearscore.sources.payloads import parsed


def times(p: Column) -> tuple[Column, Column]:
    """When a parsed payload's transaction and the one before it were."""
    return S.timestamp(p["transaction"]["requested_at"]), S.timestamp(p["last_transaction"]["timestamp"])


def feature_columns(p: Column, config: ScoringConfig | None = None, now: Column | None = None, last: Column | None = None) -> dict[str, Column]:
    """FEATURES as doubles over a parsed payload; missing fields have their defaults, and an empty or absent section is
    one whose fields are all missing. now, last: times(p), where these are columns already."""
    config = config or ScoringConfig()
    norm = config.norm

    def number(section: str, name: str) -> Column:
        return F.coalesce(p[section][name], S.num(0))

    def flag(name: str) -> Column:
        return F.coalesce(p["terminal"][name], F.lit(False)).cast("int").cast("double")

    now, last = (now, last) if now is not None else times(p)
    no_last = p["last_transaction"].isNull()
    amount, average = number("transaction", "amount"), number("customer", "avg_amount")
    known = S.known(p["merchant"]["id"], p["customer"]["known_merchants"], MOST_MERCHANTS)
    return {
        "km_from_last_tx": F.when(no_last, S.num(-1)).otherwise(S.scaled(number("last_transaction", "km_from_current"), norm.max_km)),
        "card_present": flag("card_present"),
        "is_online": flag("is_online"),
        "minutes_since_last_tx": F.when(no_last, S.num(-1)).otherwise(S.scaled(S.minutes_between(now, last), norm.max_minutes)),
        "unknown_merchant": (~known).cast("int").cast("double"),
        "amount_vs_avg": F.when(average == 0, S.num(1)).otherwise(S.round4(S.clamp01(F.try_divide(amount, average) / S.num(norm.amount_vs_avg_ratio)))),
        "day_of_week": S.round4(S.day_of_week(now).cast("double") / S.num(6)),
        "km_from_home": S.scaled(number("terminal", "km_from_home"), norm.max_km),
        "amount": S.scaled(amount, norm.max_amount),
        "installments": S.scaled(number("transaction", "installments"), norm.max_installments),
        "tx_count_24h": S.scaled(number("customer", "tx_count_24h"), norm.max_tx_count_24h),
        "mcc_risk": S.mcc_risk(p["merchant"]["mcc"], config.mcc_risk),
        "hour_of_day": S.round4(F.coalesce(F.hour(now), F.lit(0)).cast("double") / S.num(23)),
        "merchant_avg_amount": S.scaled(number("merchant", "avg_amount"), norm.max_merchant_avg_amount),
    }


def featurize(df: DataFrame, payload: str = "payload", config: ScoringConfig | None = None) -> DataFrame:
    """df with a column for each feature. An empty payload text gives zeros; a text that cannot be read gives the
    features of an object without fields."""
    empty = F.col(payload) == ""
    rows = df.withColumn("__p", parsed(F.col(payload)))
    now, last = times(F.col("__p"))
    rows = rows.withColumns({"__now": now, "__last": last})  # read once for all features that need them
    features = feature_columns(F.col("__p"), config, F.col("__now"), F.col("__last"))
    return rows.select(*df.columns, *(F.when(empty, S.num(0)).otherwise(c).alias(k) for k, c in features.items()))


def vector(columns: tuple[str, ...] = FEATURES) -> Column:
    return F.array(*(F.col(c).cast("float") for c in columns))


def featurize_vector(df: DataFrame, payload: str = "payload", config: ScoringConfig | None = None) -> DataFrame:
    """df with the features as one array of floats, `vector`."""
    return featurize(df, payload, config).select(*df.columns, vector().alias("vector"))


def mcc_lookup(df: DataFrame, mcc: str, risks: DataFrame, default: float) -> DataFrame:
    """df with mcc_risk from a table (mcc, risk) joined from the left; the table has at most 10,000 codes."""
    key = S.mcc_key(F.col(mcc))
    return df.withColumn("__mcc", key).join(F.broadcast(risks.select(F.col("mcc").alias("__mcc"), "risk")), "__mcc", "left").withColumn("mcc_risk", F.coalesce("risk", S.num(default))).drop("__mcc", "risk")
