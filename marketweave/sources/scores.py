"""Leaderboards as printed: CSV files, HTML tables and JSON boards, all as placements (suite, board, metric, name, value, ord)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketweave.functions.expressions import looked_up
from marketweave.functions.names import CAPTION, ROLE, effort_of

# Columns that may hold a score, in order of preference, those that hold a name, and those printed as parts of one.
SCORE_COLUMNS = (
    "mean_score", "ECI Score", "Score", "Accuracy", "Overall score", "Average score", "Arena Score", "Pass@1", "Pass@1 score", "Score (AVG@5)", "Main score", "Pooled score", "Accuracy mean", "average_score", "% Score", "Binary accuracy",
    "Mean score", "Challenge score", "EM", "Overall accuracy", "Overall", "Average", "Average (%)", "Global average", "Percent correct", "Performance", "Correct", "Overall pass (%)", "Unguided % Solved", "Mean capability", "Average progress",
    "Win Rate (%)", "Score OPT@1", "GDP.pdf score", "120k token score", "Overall (no subtitles)",
)
NAME_COLUMNS = ("Model version", "Model", "System", "Name")
PARTS_OF_ONE = ("mean_score", "Score", "Accuracy")
#: A board with fewer rows is not read.
LEAST_ROWS = 8

# A line of a CSV file, whose quotes may hold ends of lines, and a field of a line with a comma behind it.
_LINE, _FIELD = r'(?:[^"\n]|"(?:[^"]|"")*")+', r'("(?:[^"]|"")*"|[^,]*),'


def _fields(line: Column) -> Column:
    """The fields of a line, without their quotes."""
    found = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(_FIELD), F.lit(1))
    return F.transform(found, lambda f: F.when(f.startswith('"'), F.replace(f.substr(F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))


def read_score_csvs(files: DataFrame, prefix: str = "") -> DataFrame:
    """Placements of files(path, body): the first score and name columns of a file decide, shares of one are per cent, a name's setting joins the metric.

    Lines are cut by a pattern and then lie in as many tasks as Spark deals them to. Lines of more fields than the first one go; files without such columns or with few lines give nothing.
    """
    lines = files.select("path", F.posexplode(F.regexp_extract_all(F.replace("body", F.lit("\r"), F.lit("")), F.lit(_LINE), F.lit(0))).alias("ord", "line"))
    first = lambda among: F.filter(F.array(*map(F.lit, among)), lambda c: F.array_contains("header", c))
    head = lines.where("ord = 0").select("path", _fields(F.col("line")).alias("header")).withColumns({"scores": first(SCORE_COLUMNS), "names": first(NAME_COLUMNS)}).where("size(scores) > 0 and size(names) > 0")
    head = head.select("path", F.size("header").alias("width"), F.col("scores")[0].alias("metric"), F.array_position("header", F.col("scores")[0]).cast("int").alias("_score"), F.array_position("header", F.col("names")[0]).cast("int").alias("_name"))
    rows = lines.where("ord > 0").join(head, "path").withColumn("f", _fields(F.col("line"))).where("size(f) <= width")
    rows = rows.join(rows.groupBy("path").agg(F.count("*").alias("_n")).where(F.col("_n") >= LEAST_ROWS), "path")
    value = F.try_element_at("f", F.col("_score")).try_cast("double")
    value = F.when(F.col("metric").isin(*PARTS_OF_ONE) & value.between(0, 1), value * 100).otherwise(value)
    stem = F.replace(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.csv$", ""), F.lit("_external"), F.lit(""))
    words = F.trim(F.replace(stem, F.lit("_"), F.lit(" ")))
    rows = rows.select(stem.alias("suite"), F.concat(F.upper(F.substring(words, 1, 1)), F.lower(words.substr(F.lit(2), F.length(words)))).alias("board"), "metric", F.trim(F.try_element_at("f", F.col("_name"))).alias("name"), F.round(value, 3).alias("value"), (F.col("ord") - 1).cast("long").alias("ord"))
    rows = rows.where("value is not null and name <> ''")
    metric = F.concat(F.col("metric"), F.coalesce(F.concat(F.lit(" ("), effort_of(F.col("name")), F.lit(")")), F.lit("")))
    suite = F.when(F.col("suite").startswith(prefix), F.col("suite")).otherwise(F.concat(F.lit(prefix), F.col("suite")))
    return rows.withColumn("metric", metric).withColumn("suite", suite)


def _cells(row: Column) -> Column:
    """The texts of a table row's cells."""
    found = F.regexp_extract_all(F.regexp_replace(row, "(?s)<svg.*?</svg>", " "), F.lit(r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
    return F.transform(found, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " ")))


def clean_name(cell: Column) -> Column:
    """A model's name without a caption or role behind it, brackets round; the cell itself if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(cell, CAPTION, ""), ROLE, "")
    s = F.trim(F.regexp_replace(F.trim(F.regexp_replace(s, r"\s*\[([^\]]+)\]\s*", " ($1) ")), r"\s{2,}", " "))
    return F.when(s == "", cell).otherwise(s)


def extract_html_table(pages: DataFrame, model_column: str, score_column: str, key: str = "url", html: str = "html", least: int = LEAST_ROWS) -> DataFrame:
    """(key, name, value, ord) of the widest table of every page, if one of its first four rows has both columns and enough rows have a number."""
    tables = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit("(?s)<table.*?</table>"), F.lit(0))
    widest = F.reduce(tables, F.lit(""), lambda a, b: F.when(F.length(b) >= F.length(a), b).otherwise(a))
    rows = F.transform(F.regexp_extract_all(widest, F.lit("(?s)<tr[^>]*>.*?</tr>"), F.lit(0)), _cells)
    is_model, is_score = lambda c: F.lower(c) == model_column.lower(), lambda c: F.contains(F.lower(c), F.lit(score_column.lower()))
    page = pages.select(F.col(key).alias("key"), rows.alias("rows"))
    page = page.withColumn("head", F.get(F.filter(F.slice("rows", 1, 4), lambda r: F.exists(r, is_model) & F.exists(r, is_score)), F.lit(0))).where("head is not null")
    at = lambda test: F.array_position(F.transform("head", test), True).cast("int")
    page = page.withColumns({"mi": at(is_model), "si": at(is_score)}).select("*", F.posexplode("rows").alias("ord", "cells"))
    page = page.where("size(cells) >= greatest(mi, si) and cells <> head")
    value = F.regexp_extract(F.replace(F.element_at("cells", F.col("si")), F.lit(","), F.lit("")), r"-?\d[\d,]*\.?\d*", 0).try_cast("double")
    found = page.select("key", clean_name(F.element_at("cells", F.col("mi"))).alias("name"), value.alias("value"), F.col("ord").cast("long").alias("ord")).where((F.col("name") != "") & (F.lower("name") != model_column.lower()) & F.col("value").isNotNull())
    enough = found.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("key")
    return found.join(enough, "key", "left_semi")


# Data sets of a board file and the boards they are.
DATASETS = {"v1_Semi_Private": "arc_agi_1", "v2_Semi_Private": "arc_agi_2", "v3_Semi_Private": "arc_agi_3", "v1_Public_Eval": "arc_agi_1_public", "v2_Public_Eval": "arc_agi_2_public"}


def dataset_board(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Placements of a JSON list of evaluations: known data sets, shares as per cent, a label or else the model's id, its setting in the metric."""
    rows = bodies.select(F.posexplode(F.from_json(body, "array<struct<datasetId: string, score: double, displayLabel: string, modelId: string>>")).alias("ord", "i"))
    name = F.coalesce(F.when(F.trim("i.displayLabel") != "", F.col("i.displayLabel")), "i.modelId")
    rows = rows.select(looked_up(F.col("i.datasetId"), DATASETS).alias("suite"), F.col("i.datasetId").alias("board"), name.alias("name"), F.round(F.col("i.score") * 100, 2).alias("value"), F.col("ord").cast("long").alias("ord")).where("suite <> '' and value is not null and name is not null")
    metric = F.concat(F.lit("Score (%)"), F.coalesce(F.concat(F.lit(" ("), effort_of(F.col("name")), F.lit(")")), F.lit("")))
    return rows.select("suite", "board", metric.alias("metric"), "name", "value", "ord")


def elo_board(bodies: DataFrame, suite: str, board: str, body: str = "body") -> DataFrame:
    """Placements of a JSON list of rated rows that are not suspended."""
    row = "struct<name: string, elo: double, suspended: boolean>"
    rows = bodies.select(F.posexplode(F.coalesce(F.from_json(body, f"struct<rows: array<{row}>>")["rows"], F.from_json(body, f"array<{row}>"))).alias("ord", "i"))
    rows = rows.where("i.elo is not null and not coalesce(i.suspended, false)")
    return rows.select(F.lit(suite).alias("suite"), F.lit(board).alias("board"), F.lit("Elo").alias("metric"), F.coalesce("i.name", F.lit("")).alias("name"), F.col("i.elo").alias("value"), F.col("ord").cast("long").alias("ord"))


def riding_boards(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Placements that ride in a price feed: two indices and a rating for every category."""
    m = "struct<id: string, name: string, benchmarks: struct<artificial_analysis: struct<coding_index: double, agentic_index: double>, design_arena: array<struct<elo: double, category: string, arena: string>>>>"
    rows = bodies.select(F.posexplode(F.from_json(body, f"struct<data: array<{m}>>")["data"]).alias("ord", "m")).withColumn("name", F.coalesce("m.name", "m.id", F.lit("")))
    indices = F.array(*(F.struct(F.lit(s).alias("suite"), F.lit(s).alias("board"), F.lit("Index").alias("metric"), F.col("m.benchmarks.artificial_analysis")[f].alias("value")) for f, s in (("coding_index", "aa_coding_index"), ("agentic_index", "aa_agentic_index"))))
    category = lambda r: F.trim(F.coalesce(r["category"], F.lit("")))
    arena = lambda r: F.trim(F.coalesce(r["arena"], F.lit("")))
    suite = lambda r: F.concat(F.lit("design_arena_"), F.regexp_replace(F.regexp_replace(F.lower(category(r)), "[^a-z0-9]+", "_"), "^_+|_+$", ""))
    board = lambda r: F.concat(category(r), F.when((arena(r) != "") & (arena(r) != category(r)), F.concat(F.lit(" ("), arena(r), F.lit(")"))).otherwise(""))
    rated = F.transform(F.filter(F.coalesce("m.benchmarks.design_arena", F.array().cast("array<struct<elo:double,category:string,arena:string>>")), lambda r: category(r) != ""), lambda r: F.struct(suite(r).alias("suite"), board(r).alias("board"), F.lit("Elo").alias("metric"), r["elo"].alias("value")))
    return rows.select("name", F.col("ord").cast("long").alias("ord"), F.inline(F.concat(indices, rated))).where("value is not null").select("suite", "board", "metric", "name", "value", "ord")
