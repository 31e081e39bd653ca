"""Products: normalisation, cache refresh, scoring against profiles, energy needs, scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grocerlake.functions.text import strings
from grocerlake.sources.tables import deal

# Ingredient words by group, and messages of the scoring rules.
ANIMAL = "beef pork chicken fish meat gelatin bacon ham cá thịt gà bò heo".split()
DAIRY = ["milk", "lactose", "whey", "casein", "cheese", "butter", "sữa", "phô mai", "bơ"]
EGG = ["egg", "albumin", "trứng"]
GLUTEN = ["gluten", "wheat", "barley", "rye", "malt", "lúa mì", "đại mạch"]
VEGAN = [*ANIMAL, *DAIRY, *EGG, "honey", "mật ong"]
ACTIVITY_FACTORS = {"sedentary": 1.2, "light": 1.375, "moderate": 1.55, "very_active": 1.725, "extra_active": 1.9}
REQUIRED_NUTRIMENTS = ["sugars_100g", "sodium_100g", "proteins_100g", "energy-kcal_100g"]
NO_WARNING = "Không phát hiện cảnh báo lớn từ dữ liệu hiện có."
USER_CONFIRMED = "package_ocr_user_confirmed"


def _filled(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def tags(values: Column) -> Column:
    """Tags of an array, without the ``en:`` mark, trimmed, blanks dropped."""
    shown = F.filter(values, lambda v: F.length(F.trim(v)) > 0)
    return F.transform(shown, lambda v: F.trim(F.replace(v, F.lit("en:"), F.lit(""))))


def _tags_or_text(values: Column, text: Column) -> Column:
    listed = F.filter(F.transform(F.split(text, ","), lambda v: F.trim(v)), lambda v: F.length(v) > 0)
    return F.coalesce(F.when(F.size(values) > 0, tags(values)), listed, strings([]))


def completeness_score(name, brand, categories, ingredients, allergens, additives, nutriscore, image, nutriments) -> Column:
    """Share, in percent to one place, of eight fields and four nutriments that are there."""
    n = F.lit(0)
    for text in (name, brand, ingredients, nutriscore, image):
        n = n + F.when(F.length(text) > 0, 1).otherwise(0)
    for items in (categories, allergens, additives):
        n = n + F.when(F.size(items) > 0, 1).otherwise(0)
    for key in REQUIRED_NUTRIMENTS:
        n = n + F.when(nutriments[key].isNotNull(), 1).otherwise(0)
    return F.round(n / 12 * 100, 1)


def normalize_products(payloads: DataFrame, as_of: Column) -> DataFrame:
    """(barcode, status, product struct) to rows of the product cache.  Empty texts count as missing."""
    p = lambda name: F.col(f"product.{name}")
    out = payloads.select(
        "barcode",
        F.coalesce(_filled(p("product_name")), p("generic_name")).alias("name"),
        p("brands").alias("brand"),
        _tags_or_text(p("categories_tags"), p("categories")).alias("categories"),
        p("ingredients_text").alias("ingredients_text"),
        _tags_or_text(p("allergens_tags"), p("allergens")).alias("allergens"),
        _tags_or_text(p("additives_tags"), p("additives")).alias("additives"),
        F.coalesce(p("nutriments"), F.create_map().cast("map<string,string>")).alias("nutriments"),
        p("nutriscore_grade").alias("nutriscore"),
        p("ecoscore_grade").alias("ecoscore"),
        F.coalesce(_filled(p("image_front_url")), p("image_url")).alias("image_url"),
        F.lit("open_food_facts").alias("source"),
        F.struct(F.col("status").alias("status"), p("last_modified_t").alias("last_modified_t"), p("rev").alias("rev")).alias("raw_summary"),
    )
    score = completeness_score(*[F.col(c) for c in ("name", "brand", "categories", "ingredients_text", "allergens", "additives", "nutriscore", "image_url", "nutriments")])
    return out.withColumn("completeness_score", score).withColumn("cached_at", as_of)


def nutriment_num(nutriments: Column, *keys: str) -> Column:
    """The first of the keys that holds a number, as a double."""
    return F.coalesce(*[nutriments[k].try_cast("double") for k in keys])


def tag_tokens(values: Column) -> Column:
    """Distinct cleaned values with their parts between dashes and underscores, sorted."""
    clean = F.transform(F.coalesce(values, strings([])), lambda v: F.trim(F.replace(F.lower(v), F.lit("en:"), F.lit(""))))
    parts = F.filter(F.transform(F.flatten(F.transform(clean, lambda v: F.split(v, "[-_]"))), lambda v: F.trim(v)), lambda v: v != "")
    return F.array_sort(F.array_distinct(F.concat(clean, parts)))


def keyword_hits(text: Column, keywords) -> Column:
    """Sorted keywords that occur in the text; none for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(strings(sorted(keywords)), lambda k: F.contains(low, k))


def risk_level(score: Column) -> Column:
    return F.when(score >= 75, "low").when(score >= 45, "medium").otherwise("high")


def score_label(score: Column) -> Column:
    return F.when(score >= 80, "Tốt").when(score >= 65, "Khá ổn").when(score >= 45, "Cần cân nhắc").otherwise("Rủi ro cao")


def score_products(pairs: DataFrame) -> DataFrame:
    """Products joined with profiles to score, label, risk_level, warnings, good_points, missing_data.

    Needs nutriments, allergens, additives, nutriscore, ingredients_text of the product and goal,
    diet, allergies of the profile.  Where many requests ask for few products, ``score_requests`` reads each product once.
    """
    return _judge(_features(pairs))


def score_requests(requests: DataFrame, products: DataFrame) -> DataFrame:
    """Requests (barcode, goal, diet, allergies, ...) for products to the same; a product's numbers, tags and key words are found once, before the join.

    Products are dealt by barcode before that, as the join would after it: a file of short rows makes few tasks.

    Requests for unknown products give no row.
    """
    return _judge(requests.join(_features(deal(products, "barcode")), "barcode"))


_FEATURES = ["_sugar", "_sodium", "_fat", "_protein", "_fiber", "_energy", "_tags", "_meat", "_vegan", "_gluten", "_lactose"]


def _features(products: DataFrame) -> DataFrame:
    """Add what scoring reads of a product."""
    n, text = F.col("nutriments"), F.col("ingredients_text")
    sodium = F.coalesce(nutriment_num(n, "sodium_100g", "sodium"), nutriment_num(n, "salt_100g", "salt") / 2.5)
    tags, both = tag_tokens(F.col("allergens")), F.array_distinct(F.concat(tag_tokens(F.col("allergens")), tag_tokens(F.col("additives"))))

    def hits(words, tags: Column | None = None, names=()) -> Column:
        found = keyword_hits(text, words)
        return found if tags is None else F.array_sort(F.array_distinct(F.concat(found, F.array_intersect(tags, strings(names)))))

    values = [
        nutriment_num(n, "sugars_100g", "sugars"), sodium, nutriment_num(n, "saturated-fat_100g", "saturated_fat_100g"), nutriment_num(n, "proteins_100g", "protein_100g"), nutriment_num(n, "fiber_100g", "fiber"),
        nutriment_num(n, "energy-kcal_100g", "energy_kcal_100g", "energy-kcal"), tags, hits(ANIMAL), hits(VEGAN, both, ["milk", "egg", "eggs"]), hits(GLUTEN, tags, ["gluten", "wheat", "barley"]), hits(DAIRY, tags, ["milk", "lactose"]),
    ]
    return products.withColumns(dict(zip(_FEATURES, values)))


def _judge(rows: DataFrame) -> DataFrame:
    """The rules, each a condition with points and a message, in fixed order."""
    goal, c = F.col("goal"), F.col
    grade, n_added = F.lower(c("nutriscore")), F.coalesce(F.size("additives"), F.lit(0))
    diet = F.replace(F.lower(F.coalesce(_filled(c("diet")), _filled(goal), F.lit(""))), F.lit("-"), F.lit("_"))
    rows = rows.withColumns({"_shared": F.array_sort(F.array_intersect(tag_tokens(F.col("allergies")), "_tags")), "_diet": diet})
    diet, shared = c("_diet"), c("_shared")

    def listed(prefix: str, items: Column, most: int | None = None) -> Column:
        return F.concat(F.lit(prefix), F.array_join(F.slice(items, 1, most) if most else items, ", "), F.lit("."))

    meat, vegan, gluten, lactose = c("_meat"), c("_vegan"), c("_gluten"), c("_lactose")
    bad = [
        (c("_sugar") >= 22.5, -18, F.lit("Đường cao trên mỗi 100g/ml.")),
        ((c("_sugar") >= 10) & (c("_sugar") < 22.5), -8, F.lit("Đường hơi cao, nên cân nhắc nếu đang hạn chế đường.")),
        (c("_sodium") >= 0.6, -14, F.lit("Sodium cao, không lý tưởng cho mục tiêu ít muối.")),
        (c("_fat") >= 5, -12, F.lit("Chất béo bão hòa cao.")),
        ((c("_protein") < 10) & (goal == "high_protein"), -8, F.lit("Protein chưa nổi bật so với mục tiêu tăng protein.")),
        ((c("_energy") >= 450) & (goal == "weight_loss"), -10, F.lit("Năng lượng cao cho mục tiêu kiểm soát cân nặng.")),
        (F.size(shared) > 0, -35, listed("Có chất gây dị ứng trùng với hồ sơ: ", shared)),
        (n_added >= 6, -8, F.lit("Sản phẩm có nhiều phụ gia; nên đọc kỹ thành phần.")),
        (n_added.between(1, 5), 0, listed("Có phụ gia: ", c("additives"), 4)),
        (grade.isin("d", "e"), -8, F.concat(F.lit("Nutri-Score "), F.upper(grade), F.lit(" cho thấy cần cân nhắc."))),
        ((goal == "low_sugar") & (c("_sugar") >= 10), -8, F.lit("Không phù hợp nếu cần hạn chế đường nghiêm ngặt.")),
        ((goal == "low_sodium") & (c("_sodium") >= 0.12), -6, F.lit("Chưa tối ưu cho mục tiêu ít sodium.")),
        ((diet == "vegetarian") & (F.size(meat) > 0), -18, listed("Có dấu hiệu nguyên liệu từ thịt/cá, không phù hợp vegetarian: ", meat, 4)),
        ((diet == "vegan") & (F.size(vegan) > 0), -22, listed("Có dấu hiệu không phù hợp vegan: ", vegan, 5)),
        ((diet == "gluten_free") & (F.size(gluten) > 0), -24, listed("Có dấu hiệu chứa gluten/lúa mì: ", gluten, 5)),
        ((diet == "lactose_free") & (F.size(lactose) > 0), -24, listed("Có dấu hiệu chứa sữa/lactose: ", lactose, 5)),
    ]
    good = [
        (c("_sugar") < 10, 0, F.lit("Lượng đường thấp hoặc vừa phải.")),
        (c("_sodium") <= 0.12, 0, F.lit("Sodium ở mức thấp.")),
        (c("_fat") <= 1.5, 0, F.lit("Chất béo bão hòa thấp.")),
        (c("_protein") >= 10, 8, F.lit("Protein khá tốt.")),
        (c("_fiber") >= 6, 6, F.lit("Chất xơ tốt.")),
        (grade.isin("a", "b"), 6, F.concat(F.lit("Nutri-Score "), F.upper(grade), F.lit(" là tín hiệu tích cực."))),
    ]
    points = F.lit(70)
    for condition, n_points, _ in bad + good:
        points = points + F.when(condition, n_points).otherwise(0)
    told = lambda rules: F.filter(F.array(*[F.when(cond, text) for cond, _, text in rules]), lambda x: x.isNotNull())
    absent = [("energy-kcal_100g", "_energy"), ("fiber_100g", "_fiber"), ("proteins_100g", "_protein"), ("saturated-fat_100g", "_fat"), ("sodium_100g", "_sodium"), ("sugars_100g", "_sugar")]
    out = rows.withColumns({"score": F.greatest(F.lit(0), F.least(F.lit(100), points)), "warnings": told(bad), "good_points": told(good)})
    return out.withColumns(
        {
            "warnings": F.when(F.size("warnings") > 0, F.col("warnings")).otherwise(strings([NO_WARNING])),
            "missing_data": F.filter(F.array(*[F.when(c(v).isNull(), F.lit(k)) for k, v in absent]), lambda x: x.isNotNull()),
            "label": score_label(c("score")),
            "risk_level": risk_level(c("score")),
        }
    ).drop(*_FEATURES, "_shared", "_diet")


def compare_products(pairs: DataFrame, products: DataFrame) -> DataFrame:
    """(left_code, right_code) side by side: six dimensions and a recommendation.

    Left out are pairs of which a product is unknown.  The higher completeness is
    recommended, ties say so.
    """
    shown = products.select(
        "barcode", "name", F.upper("nutriscore").alias("nutriscore"), "completeness_score",
        *[nutriment_num(F.col("nutriments"), k).alias(a) for k, a in (("sugars_100g", "sugars"), ("sodium_100g", "sodium"), ("proteins_100g", "proteins"), ("fiber_100g", "fiber"))],
    )
    side = lambda s: shown.select(F.col("barcode").alias(f"{s}_code"), *[F.col(x).alias(f"{s}_{x}") for x in shown.columns if x != "barcode"])
    both = pairs.join(side("left"), "left_code").join(side("right"), "right_code")
    rows = [("sugars", "sugars"), ("sodium", "sodium"), ("proteins", "proteins"), ("fiber", "fiber"), ("nutriscore", "nutriscore"), ("completeness", "completeness_score")]
    table = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"left_{v}").cast("string").alias("left"), F.col(f"right_{v}").cast("string").alias("right")) for k, v in rows])
    left, right = F.col("left_completeness_score"), F.col("right_completeness_score")
    pick = F.when(left > right, F.col("left_name")).when(right > left, F.col("right_name")).otherwise("equal")
    return both.select("left_code", "right_code", table.alias("dimensions"), pick.alias("recommendation"))


def tdee(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(energy needs, rejects): Mifflin-St Jeor with an activity factor and a bounded deficit.

    Rejected rows carry the list of missing fields.  Kilocalories are rounded half to even.
    """
    fields = ["biological_sex", "age", "height_cm", "weight_kg", "activity_level"]
    missing = F.filter(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    checked = profiles.withColumn("missing", missing)
    male = F.col("biological_sex") == "male"
    factor = F.create_map(*[F.lit(x) for kv in ACTIVITY_FACTORS.items() for x in kv])[F.col("activity_level")]
    d = checked.where(F.size("missing") == 0).drop("missing")
    d = d.withColumn("_bmr", 10 * F.col("weight_kg") + 6.25 * F.col("height_cm") - 5 * F.col("age") + F.when(male, 5).otherwise(-161))
    d = d.withColumn("activity_factor", factor).withColumn("_tdee", F.col("_bmr") * factor)
    d = d.withColumn("_loss", F.coalesce("target_weight_loss_kg_week", F.lit(0.0))).withColumn("_asked", F.col("_loss") * 7700 / 7)
    floor = F.when(male, 1500).otherwise(1200)
    d = d.withColumn("_most", F.least(F.col("_tdee") * 0.25, F.greatest(F.lit(0.0), F.col("_tdee") - floor))).withColumn("_deficit", F.least("_asked", "_most"))
    kcal = lambda x: F.bround(x, 0).cast("int")
    notes = F.filter(F.array(F.when(F.col("_asked") > F.col("_most"), F.lit("deficit_capped")), F.when(F.col("_loss") > F.col("weight_kg") * 0.01, F.lit("loss_above_one_percent")), F.lit("estimate")), lambda x: x.isNotNull())
    out = d.withColumns(
        {
            "bmr_kcal": kcal(F.col("_bmr")), "tdee_kcal": kcal(F.col("_tdee")), "requested_deficit_kcal": kcal(F.col("_asked")), "recommended_deficit_kcal": kcal(F.col("_deficit")),
            "target_calories_kcal": kcal(F.col("_tdee") - F.col("_deficit")), "maintenance_low_kcal": kcal(F.col("_tdee") * 0.9), "maintenance_high_kcal": kcal(F.col("_tdee") * 1.1),
            "recommended_loss_kg_week": F.bround(F.col("_deficit") * 7 / 7700, 2), "warnings": notes,
        }
    )
    return out.drop("_bmr", "_tdee", "_loss", "_asked", "_most", "_deficit"), checked.where(F.size("missing") > 0)


def record_scans(requests: DataFrame, profiles: DataFrame, products: DataFrame, as_of: Column) -> DataFrame:
    """Scan requests (user_id, barcode) to rows of the scan history; without a profile the goal is general.

    Requests for unknown products give no row.
    """
    known = profiles.select("user_id", "goal", "diet", "allergies")
    asked = requests.join(known, "user_id", "left").withColumn("goal", F.coalesce("goal", F.lit("general")))
    return score_requests(asked, products).select("user_id", "barcode", "score", "warnings", as_of.alias("created_at"))


def latest_by(df: DataFrame, key: str, order: str | None) -> DataFrame:
    """The row of each key with the greatest ``order``; of equal ones, or without an order, the first by all its columns."""
    first = [F.col(order).desc_nulls_last()] if order else []
    w = Window.partitionBy(key).orderBy(*first, F.to_json(F.struct("*")))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def refresh_products(cache: DataFrame, fetched: DataFrame, as_of: Column, ttl_hours: int = 168) -> DataFrame:
    """Cache (barcode, ..., source, cached_at) and fetch results (the same with ``fetch_status`` ok, not_found or error).

    Rows a user confirmed, and fresh ones, stay; stale or missing rows take the fetched row, stamped ``as_of``; a
    failed fetch keeps the stale row.  Age must exceed the time to live to be stale; no time is stale.
    ``outcome`` tells: kept_ocr, fresh, refreshed, inserted, stale_fallback, not_found, upstream_error, unrequested.
    """
    fields = [c for c in cache.columns if c != "barcode"]
    old, new = cache.withColumn("_had", F.lit(True)), fetched.select("barcode", "fetch_status", *[F.col(c).alias(f"_new_{c}") for c in fields])
    both = old.join(new, "barcode", "full_outer")
    had = F.col("_had").isNotNull()
    age = as_of.cast("double") - F.col("cached_at").cast("timestamp").cast("double")
    stale = F.coalesce(age > ttl_hours * 3600, F.lit(True))
    status = F.col("fetch_status")
    outcome = (
        F.when(had & (F.col("source") == USER_CONFIRMED), "kept_ocr")
        .when(had & ~stale, "fresh")
        .when(status == "ok", F.when(had, "refreshed").otherwise("inserted"))
        .when(status == "not_found", "not_found")
        .when(status.isNotNull(), F.when(had, "stale_fallback").otherwise("upstream_error"))
        .otherwise("unrequested")
    )
    taken = F.col("outcome").isin("refreshed", "inserted")
    merged = [(as_of if c == "cached_at" else F.col(f"_new_{c}"), c) for c in fields]
    return both.withColumn("outcome", outcome).select("barcode", *[F.when(taken, n).otherwise(F.col(c)).alias(c) for n, c in merged], "outcome")


def upsert_products(cache: DataFrame, incoming: DataFrame, as_of: Column) -> DataFrame:
    """One row a barcode: the latest incoming one, stamped ``as_of``, before the cached one."""
    latest = latest_by(incoming, "barcode", "updated_at" if "updated_at" in incoming.columns else None)
    stamped = latest.withColumn("cached_at", as_of).select(*cache.columns)
    return cache.join(stamped.select("barcode"), "barcode", "left_anti").unionByName(stamped)
