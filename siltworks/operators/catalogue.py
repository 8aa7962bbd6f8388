"""The column catalogue: roles, keys, domain, and the KPIs, cleaning steps and tables that follow from them.

Everything is a job over profile rows (table_name, column, ...) of as many tables as there are; a
keyword list is a small table of fixed values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltworks.functions import values as v

from .profile import ID_TOKENS

#: The words that names of columns are known by, by kind, role and priority.
VOCABULARY = {
    "measure": {
        "RATIO": ("ratio", "rate", "taux", "pct", "percent", "percentage", "pourcentage", "share"),
        "PRICE": ("price", "prix", "unit_price", "prix_unitaire", "tarif"),
        "QUANTITY": ("quantity", "qty", "quantite", "qte", "units", "unites", "count", "nb", "nombre", "volume"),
        "TAX": ("tax", "taxe", "taxes", "tva", "vat"),
        "LEVEL": ("age", "temperature", "temp", "humidity", "humidite", "pressure", "pression", "score", "note", "rating", "grade", "level", "niveau", "speed", "vitesse", "altitude", "satisfaction", "average", "avg", "mean", "moyenne", "moy"),
        "AMOUNT": ("amount", "montant", "revenue", "revenu", "revenus", "sales", "ventes", "ca", "chiffre_affaires", "turnover", "cost", "cout", "spend", "depense", "payment", "paiement", "total"),
    },
    "contact": {
        "CONTACT": ("email", "mail", "courriel", "phone", "telephone", "tel", "mobile", "fax"),
    },
    "dimension": {
        "GEOGRAPHY": ("country", "pays", "city", "ville", "region", "zip", "zipcode", "postal", "postcode", "code_postal", "address", "adresse", "latitude", "lat", "longitude", "lon", "lng", "departement", "province", "continent"),
        "STATUS": ("status", "statut", "etat"),
        "DATE_PART": ("year", "annee", "month", "mois", "quarter", "trimestre", "week", "semaine", "weekday"),
        "CATEGORY": ("category", "categorie", "type", "segment", "class", "classe", "family", "famille", "channel", "canal", "group", "groupe", "brand", "marque"),
    },
    "temporal": {
        "TIMESTAMP": ("timestamp", "datetime", "at", "time", "heure", "horodatage"),
        "DATE": ("date", "day", "jour", "dt"),
    },
    "entity": {
        "CUSTOMER": ("customer", "client", "cust", "buyer", "acheteur"),
        "PRODUCT": ("product", "produit", "item", "article", "sku"),
        "ORDER": ("order", "commande"),
        "TRANSACTION": ("transaction", "txn", "invoice", "facture"),
    },
}
#: Words of a status that say that a sale was called off.
CANCELLATION = ("cancelled", "canceled", "cancel", "annule", "annulee", "annulation")
SALES_ENTITIES = ("CUSTOMER", "PRODUCT", "ORDER", "TRANSACTION")
MAX_AXIS_VALUES, MAX_BREAKDOWNS, MAX_LEVELS, MAX_AGGREGATES = 50, 4, 2, 3
AXIS_PRIORITY = {"PRODUCT": 0, "CUSTOMER": 1, "GEOGRAPHY": 2, "CATEGORY": 3, "STATUS": 4}
UNIQUE_ROWS = 10
#: How sure a role is, by what tells it.
CONFIDENCE = {
    "empty": 0.3,
    "temporal_named": 0.95,
    "temporal": 0.8,
    "contact": 0.9,
    "identifier_both": 0.95,
    "identifier_named": 0.85,
    "identifier_unique": 0.6,
    "number_dimension": 0.75,
    "measure_named": 0.9,
    "measure_ratio": 0.55,
    "measure": 0.6,
    "flag": 0.8,
    "dimension_categorical": 0.9,
    "dimension": 0.8,
    "categorical_entity": 0.85,
    "categorical": 0.6,
    "attribute": 0.5,
    "foreign_key_entity": 0.8,
    "foreign_key": 0.6,
    "accepted": 0.95,
}
#: How sure a KPI is; a factor for KPIs derived from others, one for sums of measures without a role, the figure of a count of lines.
DERIVED, PLAIN_SUM, LINE_COUNT = 0.95, 0.8, 0.95
#: A sales table has DOMAIN_BASE and DOMAIN_STEP for each sign, DOMAIN_MOST at most.
DOMAIN_BASE, DOMAIN_STEP, DOMAIN_MOST = 0.5, 0.1, 0.95


def keywords(spark: SparkSession) -> DataFrame:
    rows = [(kind, role, word, priority) for kind, roles in VOCABULARY.items() for priority, (role, word) in enumerate((r, w) for r, ws in roles.items() for w in ws)]
    return spark.createDataFrame(rows, "kind string, role string, keyword string, priority int")


def match_keywords(names: DataFrame, column: str = "column") -> DataFrame:
    """(column, measure, contact, dimension, temporal, entity): for each name and kind, the first role one of whose keywords is a run of
    its words. Names and keywords meet on the keyword's first word."""
    spark = names.sparkSession
    words = F.concat(F.lit("_"), F.concat_ws("_", v.name_tokens(F.col(column))), F.lit("_"))
    distinct = names.select(column).distinct()
    tokens = distinct.select(column, words.alias("_words"), F.explode(F.array_distinct(v.name_tokens(F.col(column)))).alias("_token"))
    known = keywords(spark).withColumn("_token", F.substring_index("keyword", "_", 1))
    found = tokens.join(F.broadcast(known), "_token").where(F.contains("_words", F.concat(F.lit("_"), "keyword", F.lit("_"))))
    best = found.groupBy(column).agg(*[F.min_by(F.when(F.col("kind") == k, F.col("role")), F.when(F.col("kind") == k, F.col("priority"))).alias(k) for k in VOCABULARY])
    return distinct.join(best, column, "left")


def roles(profile: DataFrame) -> DataFrame:
    """(table_name, position, column, semantic_role, business_role, entity, confidence) of each profile row."""
    p = profile.join(match_keywords(profile), "column")
    c = F.col
    kind = c("inferred_type")
    between = (kind == "decimal") & (c("min_number") >= 0) & (c("max_number") <= 1)
    strong = F.arrays_overlap(v.name_tokens(c("column")), F.array(*map(F.lit, ID_TOKENS)))
    dimension = c("dimension")
    dimension_wins = dimension.isNotNull() & ((dimension == "GEOGRAPHY") | ~(strong | c("is_unique")))
    free_text = (F.size("identifier_reasons") == 1) & F.array_contains("identifier_reasons", "unique_values") & c("has_blank")
    identifier = c("is_identifier_candidate") & ~dimension_wins & ~free_text
    by_name = F.array_contains("identifier_reasons", "name")
    measure = F.when((c("measure") == "LEVEL") & between, F.lit(None)).otherwise(c("measure"))

    def role(semantic: str, business: Column, confidence: Column | float) -> Column:
        return F.struct(F.lit(semantic).alias("s"), business.cast("string").alias("b"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("k"))

    none = F.lit(None)
    numeric = (
        F.when(dimension.isNotNull() & measure.isNull(), role("DIMENSION", dimension, CONFIDENCE["number_dimension"]))
        .when(measure.isNotNull(), role("MEASURE", measure, CONFIDENCE["measure_named"]))
        .when(between, role("MEASURE", F.lit("RATIO"), CONFIDENCE["measure_ratio"]))
        .otherwise(role("MEASURE", none, CONFIDENCE["measure"]))
    )
    text = (
        F.when(kind == "boolean", role("DIMENSION", F.lit("FLAG"), CONFIDENCE["flag"]))
        .when(dimension.isNotNull(), role("DIMENSION", dimension, F.when(c("is_categorical"), CONFIDENCE["dimension_categorical"]).otherwise(CONFIDENCE["dimension"])))
        .when(c("is_categorical"), role("DIMENSION", F.when(c("entity").isNull(), "CATEGORY"), F.when(c("entity").isNotNull(), CONFIDENCE["categorical_entity"]).otherwise(CONFIDENCE["categorical"])))
        .otherwise(role("ATTRIBUTE", none, CONFIDENCE["attribute"]))
    )
    chosen = (
        F.when(kind == "empty", role("ATTRIBUTE", none, CONFIDENCE["empty"]))
        .when(kind == "datetime", role("TEMPORAL", F.when(c("has_time") | F.coalesce(c("temporal") == "TIMESTAMP", F.lit(False)), "TIMESTAMP").otherwise("DATE"), F.when(c("temporal").isNotNull(), CONFIDENCE["temporal_named"]).otherwise(CONFIDENCE["temporal"])))
        .when(c("contact").isNotNull(), role("ATTRIBUTE", F.lit("CONTACT"), CONFIDENCE["contact"]))
        .when(identifier, role("IDENTIFIER", none, F.when(F.size("identifier_reasons") == 2, CONFIDENCE["identifier_both"]).when(by_name, CONFIDENCE["identifier_named"]).otherwise(CONFIDENCE["identifier_unique"])))
        .when(kind.isin("integer", "decimal"), numeric)
        .otherwise(text)
    )
    return p.withColumn("_r", chosen).select("table_name", "position", "column", c("_r.s").alias("semantic_role"), c("_r.b").alias("business_role"), "entity", c("_r.k").alias("confidence"))


def keys(profile: DataFrame, role_rows: DataFrame) -> DataFrame:
    """(table_name, position, column, relationship, referenced_entity, confidence) of identifiers that may be primary or foreign keys."""
    words = F.filter(v.name_tokens(F.col("column")), lambda t: ~t.isin(*ID_TOKENS))
    own = F.upper(F.concat_ws("_", words))
    both = role_rows.where("semantic_role = 'IDENTIFIER'").join(profile.select("table_name", "column", "is_unique", "row_count", "identifier_reasons"), ["table_name", "column"])
    entity = F.coalesce("entity", F.when(own != "", own))
    primary = F.col("is_unique") & (F.col("row_count") >= UNIQUE_ROWS)
    relationship = F.when(primary, "PRIMARY_KEY_CANDIDATE").when(F.array_contains("identifier_reasons", "name"), "FOREIGN_KEY_CANDIDATE")
    confidence = F.when(primary, F.col("confidence")).when(F.col("entity").isNotNull(), CONFIDENCE["foreign_key_entity"]).otherwise(CONFIDENCE["foreign_key"])
    return both.select("table_name", "position", "column", relationship.alias("relationship"), entity.alias("referenced_entity"), confidence.alias("confidence")).where("relationship IS NOT NULL")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Known key values of `child` that `parent` lacks."""
    return child.select(key).where(F.col(key).isNotNull()).distinct().join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def inclusions(frames: dict[str, DataFrame], columns: list[tuple[str, str]]) -> DataFrame:
    """(child, parent, n_values, missing) for every ordered pair of columns (table, column), named table.column: how many known values
    the child has, and how many of them the parent lacks. A foreign key has none missing.

    One pass over each table: values stand once with each column that has them, so a value's columns are a set of at most as many
    as are asked for; sets of values are never compared pair by pair. Values are compared as text."""
    names = [f"{t}.{c}" for t, c in columns]
    long = None
    for table, frame in frames.items():
        own = [c for t, c in columns if t == table]
        if own:
            cells = F.array(*[F.struct(F.lit(f"{table}.{c}").alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in own])
            rows = frame.select(F.explode(cells).alias("x")).select("x.*").where("value IS NOT NULL").distinct()
            long = rows if long is None else long.unionByName(rows)
    of_value = long.groupBy("value").agg(F.collect_set("column").alias("columns"))
    counts = of_value.select(F.explode("columns").alias("child"), "columns").groupBy("child").agg(F.count(F.lit(1)).alias("n_values"), *[F.count_if(F.array_contains("columns", n)).alias(f"b{i}") for i, n in enumerate(names)])
    parents = F.array(*[F.struct(F.lit(n).alias("parent"), (F.col("n_values") - F.col(f"b{i}")).alias("missing")) for i, n in enumerate(names)])
    return counts.select("child", "n_values", F.explode(parents).alias("p")).select("child", "p.parent", "n_values", "p.missing").where("child <> parent")


def domains(role_rows: DataFrame) -> DataFrame:
    """(table_name, domain, confidence): SALES with an amount or price and one more sign."""
    measure = F.col("semantic_role") == "MEASURE"
    signs = role_rows.groupBy("table_name").agg(
        F.collect_set(F.when(measure & F.col("business_role").isin("AMOUNT", "PRICE"), F.col("business_role"))).alias("money"),
        F.collect_set(F.when(measure & (F.col("business_role") == "QUANTITY"), F.col("business_role"))).alias("quantity"),
        F.collect_set(F.when(F.col("entity").isin(*SALES_ENTITIES), F.col("entity"))).alias("entities"),
    )
    n = F.size("money") + F.size("quantity") + F.size("entities")
    sales = (F.size("money") > 0) & (n >= 2)
    return signs.select("table_name", F.when(sales, "SALES").otherwise("UNKNOWN").alias("domain"), F.when(sales, F.round(F.least(F.lit(DOMAIN_MOST), DOMAIN_BASE + DOMAIN_STEP * n), 2)).otherwise(0.0).alias("confidence"))


def override(role_rows: DataFrame, accepted: DataFrame) -> DataFrame:
    """Accepted roles (table_name, column, semantic_role, business_role) instead of the inferred ones, with confidence 0.95."""
    new = accepted.select("table_name", "column", F.col("semantic_role").alias("_s"), F.col("business_role").alias("_b"))
    both = role_rows.join(new, ["table_name", "column"], "left")
    given = F.col("_s").isNotNull()
    return both.select("table_name", "position", "column", F.coalesce("_s", "semantic_role").alias("semantic_role"), F.when(given, F.col("_b")).otherwise(F.col("business_role")).alias("business_role"), "entity", F.when(given, CONFIDENCE["accepted"]).otherwise(F.col("confidence")).alias("confidence"))


def restrict(rows: DataFrame, contract: DataFrame) -> DataFrame:
    """Profile or role rows of columns that are in the contract."""
    return rows.join(contract.select("column"), "column", "left_semi")


def cancellation_values(df: DataFrame, status: str) -> DataFrame:
    """(status column, value in upper case) of all values, not of samples, that say that a sale was called off."""
    values = df.select(F.upper(v.strip(F.col(status))).alias("value")).distinct()
    return values.where(F.arrays_overlap(v.name_tokens(F.col("value")), F.array(*map(F.lit, CANCELLATION)))).select(F.lit(v.plain_name(status)).alias("column"), "value")


def _first(rows: DataFrame, condition: Column, alias: str) -> DataFrame:
    """The first column, in table order, that meets a condition, for each table."""
    return rows.where(condition).groupBy("table_name").agg(F.min_by(F.struct("column", "confidence", "business_role"), "position").alias(alias))


def kpis(role_rows: DataFrame, profile: DataFrame) -> DataFrame:
    """(table_name, kpi, formula, kind, confidence): scalar KPIs, trend and breakdowns that the roles of a table's columns allow."""
    c = F.col
    name = F.concat_ws("_", v.name_tokens(c("column")))
    rows = role_rows.withColumn("column", F.when(name != "", name).otherwise(c("column"))).join(profile.select("table_name", "position", "distinct_count"), ["table_name", "position"])
    is_ = lambda s, b=None: (c("semantic_role") == s) & (F.lit(True) if b is None else c("business_role") == b)
    of = lambda s, e: (c("semantic_role") == s) & (c("entity") == e)
    firsts = {
        "amount": is_("MEASURE", "AMOUNT"), "quantity": is_("MEASURE", "QUANTITY"), "price": is_("MEASURE", "PRICE"), "temporal": is_("TEMPORAL"),
        "order_id": of("IDENTIFIER", "ORDER"), "transaction_id": of("IDENTIFIER", "TRANSACTION"),
        "customer_id": of("IDENTIFIER", "CUSTOMER"), "customer_label": of("DIMENSION", "CUSTOMER"), "product_id": of("IDENTIFIER", "PRODUCT"), "product_label": of("DIMENSION", "PRODUCT"),
    }
    one = reduce(lambda a, b: a.join(b, "table_name", "left"), [_first(rows, cond, k) for k, cond in firsts.items()], domains(role_rows).select("table_name", "domain"))
    sales = c("domain") == "SALES"
    col = lambda k: c(f"{k}.column")
    conf = lambda k: c(f"{k}.confidence")
    fmt = lambda f, *a: F.format_string(f, *a)
    has = lambda *ks: reduce(lambda x, y: x & y, [c(k).isNotNull() for k in ks])
    main = F.when(has("amount"), fmt("SUM(%s)", col("amount"))).when(has("quantity", "price"), fmt("SUM(%s * %s)", col("quantity"), col("price")))
    main_conf = F.when(has("amount"), conf("amount")).when(has("quantity", "price"), F.round(F.least(conf("quantity"), conf("price")) * DERIVED, 2))
    label = F.when(sales, "Revenue").when(has("amount"), fmt("Total %s", col("amount"))).otherwise(fmt("Total %s x %s", col("quantity"), col("price")))
    order = F.coalesce("order_id", "transaction_id")
    one = one.withColumn("main", main).withColumn("main_conf", main_conf).withColumn("label", F.when(c("main").isNotNull(), label).otherwise("Number of Lines")).withColumn("order", order)
    one = one.withColumn("expression", F.coalesce("main", F.lit("COUNT(*)"))).withColumn("expression_conf", F.coalesce("main_conf", F.lit(LINE_COUNT)))
    spec = lambda cond, kpi, formula, kind, confidence: F.when(cond, F.struct(kpi.alias("kpi"), formula.alias("formula"), F.lit(kind).alias("kind"), F.round(confidence, 2).alias("confidence")))
    distinct_of = lambda k: fmt("COUNT(DISTINCT %s)", c(f"{k}.column"))
    one = one.withColumn("customer", F.coalesce("customer_id", "customer_label")).withColumn("product", F.coalesce("product_id", "product_label"))
    scalars = F.array_compact(F.array(
        spec(c("main").isNotNull(), c("label"), c("main"), "scalar", c("main_conf")),
        spec(has("order"), F.lit("Orders"), distinct_of("order"), "scalar", conf("order")),
        spec(~has("order"), F.lit("Number of Lines"), F.lit("COUNT(*)"), "scalar", F.lit(LINE_COUNT)),
        spec(has("quantity"), F.when(sales, "Quantity Sold").otherwise(fmt("Total %s", col("quantity"))), fmt("SUM(%s)", col("quantity")), "scalar", conf("quantity")),
        spec(c("main").isNotNull() & sales & has("order"), F.lit("Average Order Value"), F.concat("main", F.lit(" / "), distinct_of("order")), "scalar", F.least("main_conf", conf("order"))),
        spec(c("main").isNotNull() & sales & ~has("order"), F.lit("Average Revenue per Line"), F.concat("main", F.lit(" / COUNT(*)")), "scalar", c("main_conf") * DERIVED),
        spec(has("customer"), F.lit("Customers"), distinct_of("customer"), "scalar", conf("customer")),
        spec(has("product"), F.lit("Products"), distinct_of("product"), "scalar", conf("product")),
        spec(has("price"), F.lit("Average Unit Price"), fmt("AVG(%s)", col("price")), "scalar", conf("price")),
        spec(has("temporal"), F.concat("label", F.lit(" by Month")), F.concat("expression", F.lit(" GROUP BY MONTH("), col("temporal"), F.lit(")")), "trend", F.least(c("expression_conf") * DERIVED, conf("temporal"))),
    ))
    out = one.select("table_name", F.explode(scalars).alias("k")).select("table_name", "k.*")
    averages = rows.where(is_("MEASURE") & c("business_role").isin("RATIO", "LEVEL")).select("table_name", fmt("Average %s", c("column")).alias("kpi"), fmt("AVG(%s)", c("column")).alias("formula"), F.lit("scalar").alias("kind"), "confidence")
    sums = rows.where(is_("MEASURE") & c("business_role").isNull()).select("table_name", fmt("Total %s", c("column")).alias("kpi"), fmt("SUM(%s)", c("column")).alias("formula"), F.lit("scalar").alias("kind"), F.round(c("confidence") * PLAIN_SUM, 2).alias("confidence"))
    axes = _axes(rows)
    geographic = F.count_if(c("business_role") == "GEOGRAPHY").over(Window.partitionBy("table_name"))
    axes = axes.withColumn("title", F.when((c("business_role") == "GEOGRAPHY") & (geographic == 1), "Region").otherwise(F.initcap(F.replace(c("column"), F.lit("_"), F.lit(" ")))))
    main_of = one.select("table_name", "label", "expression", "expression_conf", "temporal")
    broken = axes.join(main_of, "table_name").select("table_name", F.concat("label", F.lit(" by "), "title").alias("kpi"), F.concat("expression", F.lit(" GROUP BY "), "column").alias("formula"), F.lit("breakdown").alias("kind"), F.round(F.least(c("expression_conf") * DERIVED, "confidence"), 2).alias("confidence"))
    nth = F.row_number().over(Window.partitionBy("table_name").orderBy("position"))
    levels = rows.where(is_("MEASURE", "LEVEL")).withColumn("n", nth).where(c("n") <= MAX_LEVELS).select("table_name", c("column").alias("level"), c("confidence").alias("level_conf"))
    by_month = levels.join(main_of.where("temporal IS NOT NULL"), "table_name").select("table_name", fmt("Average %s by Month", c("level")).alias("kpi"), fmt("AVG(%s) GROUP BY MONTH(%s)", c("level"), col("temporal")).alias("formula"), F.lit("trend").alias("kind"), F.round(F.least(c("level_conf") * DERIVED, conf("temporal")), 2).alias("confidence"))
    by_axis = levels.join(axes.where("axis = 1"), "table_name").select("table_name", fmt("Average %s by %s", c("level"), c("title")).alias("kpi"), fmt("AVG(%s) GROUP BY %s", c("level"), c("column")).alias("formula"), F.lit("breakdown").alias("kind"), F.round(F.least(c("level_conf") * DERIVED, "confidence"), 2).alias("confidence"))
    return reduce(DataFrame.unionByName, [out, averages, sums, broken, by_month, by_axis])


def _axes(rows: DataFrame) -> DataFrame:
    """The dimensions that a table is broken down by: few values, no date parts, by priority of entity, then role, then position."""
    c = F.col
    rank = lambda key: reduce(lambda acc, kv: F.when(key == kv[0], kv[1]).otherwise(acc), AXIS_PRIORITY.items(), F.lit(None).cast("int"))
    usable = rows.where((c("semantic_role") == "DIMENSION") & ~c("business_role").eqNullSafe("DATE_PART") & (c("distinct_count") <= MAX_AXIS_VALUES))
    order = Window.partitionBy("table_name").orderBy(F.coalesce(rank(c("entity")), rank(c("business_role")), F.lit(len(AXIS_PRIORITY))), "position")
    return usable.withColumn("axis", F.row_number().over(order)).where(c("axis") <= MAX_BREAKDOWNS)


def _joined(profile: DataFrame, role_rows: DataFrame, contract: DataFrame) -> DataFrame:
    rules = contract.select("column", F.col("type").alias("rule_type"), F.lit(True).alias("in_contract"))
    base = profile.select("table_name", "position", "column", "dtype", "inferred_type", "null_count", "row_count", "distinct_count")
    rows = base.join(role_rows.select("table_name", "position", "semantic_role", "business_role", "entity"), ["table_name", "position"]).join(F.broadcast(rules), "column", "left")
    name = F.concat_ws("_", v.name_tokens(F.col("column")))
    return rows.withColumn("final", F.when(name != "", name).otherwise(F.col("column")))


STEP_ORDER = ("rename", "trim", "cast", "normalize", "drop_null_keys", "fill_unknown", "keep_nulls", "deduplicate", "check", "derive_amount", "derive_date_parts")
DESTRUCTIVE = ("drop_null_keys", "fill_unknown", "deduplicate")


def cleaning_actions(profile: DataFrame, role_rows: DataFrame, contract: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(table_name, step, action, column, destructive): what Silver does with each column, in the order of STEP_ORDER; `duplicates` is (table_name, duplicate_rows)."""
    c = F.col
    rows = _joined(profile, role_rows, contract)
    some_null = (c("null_count") > 0) & (c("null_count") < c("row_count"))
    text = c("inferred_type") == "string"
    stored_date = c("dtype").startswith("timestamp") | (c("dtype") == "date")
    is_float = c("dtype").isin("double", "float")
    is_int = c("dtype").isin("tinyint", "smallint", "int", "bigint")
    when = {
        "rename": c("column") != c("final"),
        "trim": text,
        "cast": ((c("inferred_type") == "datetime") & ~stored_date) | ((c("inferred_type") == "integer") & is_float & ~c("rule_type").eqNullSafe("decimal")) | (c("rule_type").eqNullSafe("decimal") & is_int),
        "normalize": text & (c("semantic_role") == "DIMENSION") & c("business_role").isin("STATUS", "CATEGORY"),
        "drop_null_keys": some_null & (c("semantic_role") == "IDENTIFIER"),
        "fill_unknown": some_null & (c("semantic_role") == "DIMENSION"),
        "keep_nulls": some_null & (c("semantic_role") == "MEASURE"),
        "check": c("in_contract").isNotNull(),
    }
    actions = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(a)) for a, cond in when.items()]))
    out = rows.select("table_name", c("final").alias("column"), F.explode(actions).alias("action"))
    again = duplicates.where("duplicate_rows > 0").select("table_name", F.lit("*").alias("column"), F.lit("deduplicate").alias("action"))
    measure = lambda b: F.min_by(F.when((c("semantic_role") == "MEASURE") & (c("business_role") == b), c("final")), F.when((c("semantic_role") == "MEASURE") & (c("business_role") == b), c("position")))
    first = rows.groupBy("table_name").agg(measure("AMOUNT").alias("amount"), measure("QUANTITY").alias("quantity"), measure("PRICE").alias("price"), F.min_by(F.when(c("semantic_role") == "TEMPORAL", c("final")), F.when(c("semantic_role") == "TEMPORAL", c("position"))).alias("temporal"))
    amount = first.where("amount IS NULL AND quantity IS NOT NULL AND price IS NOT NULL").select("table_name", F.concat_ws(" * ", "quantity", "price").alias("column"), F.lit("derive_amount").alias("action"))
    dates = first.where("temporal IS NOT NULL").select("table_name", c("temporal").alias("column"), F.lit("derive_date_parts").alias("action"))
    rows = reduce(DataFrame.unionByName, [out, again, amount, dates])
    step = reduce(lambda acc, ia: F.when(c("action") == ia[1], ia[0]).otherwise(acc), enumerate(STEP_ORDER, 1), F.lit(None).cast("int"))
    return rows.select("table_name", step.alias("step"), "action", "column", c("action").isin(*DESTRUCTIVE).alias("destructive"))


def gold_specs(profile: DataFrame, role_rows: DataFrame, key_rows: DataFrame, contract: DataFrame) -> DataFrame:
    """(table_name, gold_table, kind, column, operation): the fact, dimensions and aggregates of each table, a row for each column or metric."""
    c = F.col
    rows = _joined(profile, role_rows, contract)
    role = c("semantic_role")
    s = lambda df, gold_table, kind, column, operation: df.select("table_name", gold_table.alias("gold_table"), F.lit(kind).alias("kind"), column.alias("column"), operation.alias("operation"))
    t = c("table_name")
    none = F.lit(None).cast("string")
    measure = role == "MEASURE"
    sums = c("business_role").isin("AMOUNT", "TAX", "QUANTITY")
    metrics = rows.where(measure & (sums | c("business_role").isin("PRICE", "LEVEL") | c("business_role").isNull())).select("table_name", c("final").alias("column"), F.when(sums, "SUM").otherwise("AVG").alias("operation"))
    first = rows.groupBy("table_name").agg(*[F.max(F.when(measure & (c("business_role") == b), True)).alias(b) for b in ("AMOUNT", "QUANTITY", "PRICE")], F.max(F.when(role == "TEMPORAL", True)).alias("dated"), F.max(F.when(measure, True)).alias("measured"))
    derived = first.where("AMOUNT IS NULL AND QUANTITY AND PRICE").select("table_name", F.lit("line_amount").alias("column"), F.lit("SUM").alias("operation"))
    metrics = metrics.unionByName(derived)
    fact = s(rows.where(role.isin("IDENTIFIER", "TEMPORAL", "DIMENSION", "MEASURE")).join(first.where("measured").select("table_name"), "table_name", "left_semi"), F.concat(F.lit("fact_"), t), "fact", c("final"), none)
    fact = fact.unionByName(s(derived, F.concat(F.lit("fact_"), t), "fact", c("column"), none))
    referenced = key_rows.where("relationship = 'FOREIGN_KEY_CANDIDATE' AND referenced_entity IS NOT NULL").groupBy("table_name", c("referenced_entity").alias("e")).agg(F.min_by("column", "position").alias("column"))
    labels = rows.where((role == "DIMENSION") & c("entity").isNotNull()).groupBy("table_name", c("entity").alias("e")).agg(F.min_by("final", "position").alias("label"))
    named = labels.join(referenced.select("table_name", "e"), ["table_name", "e"], "left_anti").select("table_name", "e", c("label").alias("column"))
    dim_name = F.concat(t, F.lit("_dim_"), F.lower("e"))
    dims = s(referenced.select("table_name", "e", F.concat_ws("_", v.name_tokens(c("column"))).alias("column")).unionByName(named), dim_name, "dimension", c("column"), none)
    attributes = s(rows.where((role == "DIMENSION") & c("entity").isNotNull()).select("table_name", c("entity").alias("e"), c("final").alias("column")).join(referenced.select("table_name", "e"), ["table_name", "e"], "left_semi"), dim_name, "dimension", c("column"), none)
    dates = first.where("dated").select("table_name", F.explode(F.array(*map(F.lit, ("date", "year", "quarter", "month", "day")))).alias("column"))
    dates = s(dates, F.concat(t, F.lit("_dim_date")), "dimension", c("column"), none)
    nth = F.row_number().over(Window.partitionBy("table_name").orderBy(c("entity").isNull(), "position"))
    axes = rows.where((role == "DIMENSION") & ~c("business_role").eqNullSafe("DATE_PART") & (c("distinct_count") <= MAX_AXIS_VALUES)).withColumn("n", nth).where(c("n") <= MAX_AGGREGATES)
    tables = axes.select("table_name", F.concat(t, F.lit("_by_"), "final").alias("g")).unionByName(first.where("dated").select("table_name", F.concat(t, F.lit("_by_month")).alias("g"))).unionByName(first.select("table_name", F.concat(t, F.lit("_summary")).alias("g")))
    aggregates = s(tables.join(metrics, "table_name"), c("g"), "aggregate", c("column"), c("operation"))
    return reduce(DataFrame.unionByName, [fact, dims, attributes, dates, aggregates]).distinct()
