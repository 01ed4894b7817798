"""Batch scoring of requests: contracts, overrides, decisions, registration and responses.

Everything per request is a projection or a join of the request table to a feature table, so a streaming request table
takes the same path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditlake.functions.expr import NUMERIC, dbl, finite, one_row
from creditlake.functions.ordering import durable, quantile_row, running_totals
from creditlake.functions.text import CONTRACT_TYPES, digits_only, normal_email, normal_id, translate_code
from creditlake.operators.cleaning import MISSING, numeric_columns, string_columns, try_number
from creditlake.operators.derive import derive_ratios

CLIENT, TARGET = "SK_ID_CURR", "TARGET"
MOST_CATEGORIES = 50
# Fixed texts of the payoff estimate.
BAD_CREDIT, BAD_ANNUITY = "amt_credit inválido", "annuity inválida"


# ---- contract


def infer_contract(df: DataFrame, but: tuple[str, ...] = (CLIENT, TARGET), most: int = MOST_CATEGORIES) -> DataFrame:
    """One row per feature: name, dtype ('num' or 'cat'), position and, for categories, the sorted values with
    'missing' last if absent; NULL, which allows any value, when there are more than ``most``.

    The category values of a column are ranked and cut just above the limit before they are gathered, so a column of
    unbounded variety is recognised without being collected.
    """
    names = [c for c in df.columns if c not in but]
    cats = string_columns(df, but)
    spark = df.sparkSession
    fields = spark.createDataFrame(
        [(c, "cat" if c in cats else "num", i) for i, c in enumerate(names)], "name string, dtype string, position int"
    )
    if not cats:
        return fields.withColumn("allowed", F.lit(None).cast("array<string>"))
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in cats])
    values = df.select(F.inline(pairs)).where("value IS NOT NULL").distinct()
    w = Window.partitionBy("name").orderBy("value")
    few = values.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most + 1)
    lists = few.groupBy("name").agg(F.sort_array(F.collect_list("value")).alias("v"))
    whole = F.when(F.array_contains("v", MISSING), F.col("v")).otherwise(F.concat("v", F.array(F.lit(MISSING))))
    found = lists.select("name", F.when(F.size(whole) <= most, whole).alias("allowed"))
    joined = fields.join(found, "name", "left")
    empty = F.when(F.col("dtype") == "cat", F.array(F.lit(MISSING)))
    none_seen = joined.join(lists.select("name", F.lit(1).alias("_seen")), "name", "left")
    return none_seen.select(
        "name", "dtype", "position", F.when(F.col("_seen").isNull(), empty).otherwise(F.col("allowed")).alias("allowed")
    )


def enforce_contract(df: DataFrame, contract: DataFrame, keep: tuple[str, ...] = (CLIENT,)) -> DataFrame:
    """Project rows onto the contract: its order, its types, unknown categories to NULL. A missing feature is an error.
    The contract has one row per feature and is read by the driver."""
    fields = contract.orderBy("position").collect()
    absent = [f["name"] for f in fields if f["name"] not in df.columns]
    if absent:
        raise ValueError(f"features missing from the input: {absent[:20]}")
    out = []
    for f in fields:
        c = F.col(f["name"])
        if f["dtype"] == "num":
            out.append((finite(c) if _is_numeric(df, f["name"]) else try_number(f["name"])).alias(f["name"]))
        elif f["allowed"] is None:
            out.append(F.coalesce(c.cast("string"), F.lit(MISSING)).alias(f["name"]))
        else:
            text = F.coalesce(c.cast("string"), F.lit(MISSING))
            out.append(F.when(text.isin(list(f["allowed"])), text).alias(f["name"]))
    return df.select(*[k for k in keep if k in df.columns], *out)


def _is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (*NUMERIC, T.BooleanType))


def template_row(df: DataFrame, but: tuple[str, ...] = (CLIENT,)) -> DataFrame:
    """One row: the exact median of each number (0 if it has none) and the commonest value of each text, the smallest
    among equals."""
    numbers, texts = numeric_columns(df, but), string_columns(df, but)
    medians = one_row(quantile_row(df, numbers, 0.5))
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in texts])
    counts = df.select(F.inline(pairs)).where("value IS NOT NULL").groupBy("feature", "value").count()
    modes = one_row(
        counts.groupBy("feature")
        .agg(F.min(F.struct(-F.col("count"), F.col("value").alias("value"))).getField("value").alias("value"))
        .agg(*[F.max(F.when(F.col("feature") == c, F.col("value"))).alias(c) for c in texts])
    )
    base = df.sparkSession.range(1).withColumns({"_n": medians, "_t": modes})
    wanted = [c for c in df.columns if c in numbers or c in texts]
    return base.select(
        *[
            (F.coalesce(F.col(f"_n.{c}"), F.lit(0.0)) if c in numbers else F.coalesce(F.col(f"_t.{c}"), F.lit(MISSING))).alias(c)
            for c in wanted
        ]
    )


# ---- requests


def what_if(requests: DataFrame, features: DataFrame, recompute: bool = False) -> DataFrame:
    """Stored features of the requested clients with amount, type, annuity and price overridden by the request.

    Derived columns keep their stored values unless ``recompute`` is set. ``found`` is 0 for an unknown client.
    """
    stored = features.withColumnRenamed(CLIENT, "_client").withColumn("_known", F.lit(1))
    joined = requests.join(stored, F.col("sk_id_curr") == F.col("_client"), "left")
    overrides = {
        "AMT_CREDIT": F.coalesce(dbl("amt_credit_asked"), F.col("AMT_CREDIT")),
        "AMT_ANNUITY": F.coalesce(dbl("annuity_asked"), F.col("AMT_ANNUITY")),
        "AMT_GOODS_PRICE": F.coalesce(dbl("goods_price_asked"), F.col("AMT_GOODS_PRICE")),
        "NAME_CONTRACT_TYPE": F.coalesce(translate_code("credit_type", CONTRACT_TYPES), F.col("NAME_CONTRACT_TYPE")),
    }
    out = joined.withColumns(overrides).withColumn("found", F.coalesce(F.col("_known"), F.lit(0)))
    out = derive_ratios(out) if recompute else out
    kept = [c for c in features.columns if c != CLIENT]
    return out.select("request_id", "sk_id_curr", "found", *kept)


def new_clients(requests: DataFrame, contract: DataFrame) -> DataFrame:
    """Feature rows for clients known only from the request: the map of given features projected onto the contract,
    numbers that do not parse and everything not given filled with 0 or 'missing'; the request's own fields win."""
    own = {
        "AMT_CREDIT": dbl("amt_credit_asked"),
        "AMT_ANNUITY": dbl("annuity_asked"),
        "AMT_GOODS_PRICE": dbl("goods_price_asked"),
        "NAME_CONTRACT_TYPE": translate_code("credit_type", CONTRACT_TYPES),
    }
    out = []
    for f in contract.orderBy("position").collect():
        given = F.try_element_at("features", F.lit(f["name"]))
        if f["dtype"] == "num":
            out.append(F.coalesce(own.get(f["name"], F.lit(None)), try_number(given), F.lit(0.0)).alias(f["name"]))
        else:
            text = F.coalesce(own.get(f["name"], F.lit(None)), given, F.lit(MISSING))
            allowed = f["allowed"]
            out.append((text if allowed is None else F.when(text.isin(list(allowed)), text)).alias(f["name"]))
    return requests.select("request_id", *out)


def decision(score: Column | str, threshold: float = 0.6) -> Column:
    return F.when(dbl(score) >= F.lit(threshold), "REJECT").otherwise("APPROVE")


def risk_band(score: Column | str, low: float = 0.3, high: float = 0.6) -> Column:
    return F.when(dbl(score) < low, "LOW").when(dbl(score) < high, "MODERATE").otherwise("HIGH")


def payoff(credit: Column | str, annuity: Column | str) -> Column:
    """Months and years to pay back without interest, or why there is no answer."""
    credit, annuity = finite(credit), finite(annuity)
    reason = F.when(credit.isNull() | (credit <= 0), BAD_CREDIT).when(annuity.isNull() | (annuity <= 0), BAD_ANNUITY)
    months = F.when(reason.isNull(), F.bround(credit / F.nullif(annuity, F.lit(0.0)), 1))
    return F.struct(
        reason.isNull().alias("ok"), months.alias("months"), F.bround(months / 12, 2).alias("years"), reason.alias("reason")
    )


def response(row_fields: list[Column], drivers_up: Column, drivers_down: Column) -> Column:
    """The response document of one request."""
    shap = F.struct(
        F.lit(True).alias("enabled"), drivers_up.alias("top_risk_increasing"), drivers_down.alias("top_risk_decreasing")
    )
    return F.to_json(F.struct(*row_fields, shap.alias("shap")))


def drivers_per_request(top: DataFrame, id_col: str) -> DataFrame:
    """The ranked drivers of each row as two ordered arrays (each at most as long as the ranking)."""

    def side(name: str) -> Column:
        entry = F.struct("place", "feature", "attribution")
        ordered = F.sort_array(F.collect_list(F.when(F.col("direction") == name, entry)))
        return F.transform(ordered, lambda s: F.struct(s["feature"].alias("feature"), s["attribution"].alias("shap")))

    return top.groupBy(id_col).agg(side("up").alias("drivers_up"), side("down").alias("drivers_down"))


# ---- registration


def normalised_registrations(registrations: DataFrame) -> DataFrame:
    return registrations.select(
        "registration_id",
        F.trim(F.coalesce("full_name", F.lit(""))).alias("full_name"),
        normal_id("dni").alias("dni"),
        normal_email("email").alias("email"),
        digits_only("phone").alias("phone"),
    )


def register(registrations: DataFrame, clients: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Client number of every registration, in order of registration_id (not negative).

    A registration takes the client of an earlier one that created a client under the same e-mail, else under the same
    national id; otherwise it creates the next number after the largest known. ``existing`` (SK_ID_CURR, email, dni) are
    people registered before: they come before all, and of several with one key the lowest number counts. Empty keys
    never match, and a registration that was matched does not lend its own keys to later ones.

    A row with an earlier owner can never create; a row without one creates once no earlier row that might still create
    shares its keys. Each round finds owners among those just created, reduces each key to its first possible creator
    with partial aggregates (a key held by a third of the rows is one row per task), and decides. Rounds end when
    nothing is undecided. An empty key is replaced by one of its own for each row, so that it neither matches nor
    gathers in one task.
    """
    keys, me = ("email", "dni"), F.col("registration_id")
    known = normalised_registrations(registrations)
    own = {k: F.when(F.col(k) != "", F.col(k)).otherwise(F.concat(F.lit("\0"), me.cast("string"))) for k in keys}
    pending = durable(known.select("registration_id", *[own[k].alias(k) for k in keys], *[F.lit(None).cast("long").alias(f"by_{k}") for k in keys]))
    top = clients.agg(F.max(CLIENT).alias("top"))
    fresh = None
    if existing is not None:
        # Numbers of earlier people are held as negative owners, which are before every registration.
        fresh = existing.select((-F.col(CLIENT).cast("long")).alias("registration_id"), normal_email("email").alias("email"), normal_id("dni").alias("dni"))
        top = top.unionByName(existing.agg(F.max(CLIENT).alias("top"))).agg(F.max("top").alias("top"))
    created, matched = [], []
    while True:
        view = pending
        for key in keys if fresh is not None else ():
            owners = durable(fresh.where(F.col(key) != "").groupBy(key).agg(F.max("registration_id").alias("owner")))
            view = view.join(owners, key, "left")
            view = view.withColumn(f"by_{key}", F.coalesce(f"by_{key}", F.when(F.col("owner") < me, F.col("owner")))).drop("owner")
        owned = durable(view.select(*pending.columns)) if fresh is not None else pending
        possible = owned.where("by_email IS NULL AND by_dni IS NULL")
        view = owned
        for key in keys:
            held = durable(possible.groupBy(key).agg(F.min("registration_id").alias(f"first_{key}")))
            view = view.join(held, key, "left")
        clear = {key: F.coalesce(F.col(f"first_{key}") >= me, F.lit(True)) for key in keys}
        state = (
            F.when(F.col("by_email").isNotNull() | (F.col("by_dni").isNotNull() & clear["email"]), "matched")
            .when(F.col("by_dni").isNull() & clear["email"] & clear["dni"], "created")
            .otherwise("pending")
        )
        judged = durable(view.select(*pending.columns, F.coalesce("by_email", "by_dni").alias("owner"), state.alias("state")))
        fresh = judged.where("state = 'created'").select("registration_id", *keys)
        created.append(fresh.select("registration_id"))
        matched.append(judged.where("state = 'matched'").select("registration_id", "owner"))
        pending = judged.where("state = 'pending'").select(*pending.columns)
        if pending.isEmpty():
            break
    makers = reduce(DataFrame.unionByName, created)
    numbered = running_totals(makers.withColumn("one", F.lit(1)), [], ["registration_id"], ["one"])
    last = F.coalesce(one_row(top).getField("top"), F.lit(0))
    numbers = numbered.select(F.col("registration_id").alias("owner"), (last + F.col("cum_one")).alias(CLIENT))
    everyone = reduce(DataFrame.unionByName, matched, makers.withColumn("owner", me))
    number = F.when(F.col("owner") < 0, -F.col("owner")).otherwise(F.col(CLIENT))
    return everyone.join(numbers, "owner", "left").select("registration_id", number.alias(CLIENT), (me == F.col("owner")).cast("int").alias("is_new"))
