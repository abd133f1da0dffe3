"""Recipes as one nested document: flattening, renaming, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECIPE = "struct<name:string,defaultPortion:double,batchSize:double,ingredients:array<struct<name:string,grams:double>>>"
DOCUMENT = f"map<string,{RECIPE}>"


def recipes_flatten(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """A row for each recipe: recipe_id and its fields."""
    # An inner explode would be given a filter on the document, for which Spark parses or builds it a second time; no key is null.
    rows = docs.select(F.explode_outer(doc).alias("recipe_id", "recipe")).filter("recipe_id is not null")
    return rows.select("recipe_id", "recipe.*")


def recipe_ingredients(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """A row for each ingredient with its place; a recipe without ingredients has none."""
    rows = recipes_flatten(docs, doc).select("recipe_id", F.posexplode("ingredients").alias("place", "ingredient"))
    return rows.select("recipe_id", "place", F.col("ingredient.name").alias("name"), F.col("ingredient.grams").alias("grams"))


def renamed(df: DataFrame, renames: DataFrame, name: str = "name") -> DataFrame:
    """Rows with ``name`` replaced where ``renames`` (old, new) has it; many old names may have one new, rows are never merged."""
    table = F.broadcast(renames.select(F.col("old").alias(name), "new"))  # a short table of names
    return df.join(table, name, "left").withColumn(name, F.coalesce("new", name)).drop("new")


def _lookup(renames: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in renames.items() for x in pair)) if renames else F.create_map().cast("map<string,string>")


def migrate_recipes(docs: DataFrame, dishes: dict[str, str], ingredients: dict[str, str], doc: str = "doc") -> DataFrame:
    """The document with dishes and ingredients renamed and all else as it was. Doing it twice changes nothing more.

    The rename tables are short and become literals of the plan.
    """
    dish, ingredient = _lookup(dishes), _lookup(ingredients)

    def one(recipe: Column) -> Column:
        items = F.transform(recipe["ingredients"], lambda i: i.withField("name", F.coalesce(ingredient[i["name"]], i["name"])))
        return recipe.withField("name", F.coalesce(dish[recipe["name"]], recipe["name"])).withField("ingredients", items)

    return docs.withColumn(doc, F.transform_values(doc, lambda k, v: one(v)))


def recipes_changed(before: DataFrame, dishes: dict[str, str], ingredients: dict[str, str], doc: str = "doc") -> DataFrame:
    """One row: whether the migration would change any name."""
    dish, ingredient = F.array(*map(F.lit, dishes)).cast("array<string>"), F.array(*map(F.lit, ingredients)).cast("array<string>")
    rows = recipes_flatten(before, doc)
    hit = F.array_contains(dish, F.coalesce("name", F.lit(""))) | F.exists(F.coalesce("ingredients", F.array().cast("array<struct<name:string,grams:double>>")), lambda i: F.array_contains(ingredient, F.coalesce(i["name"], F.lit(""))))
    return rows.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("changed"))
