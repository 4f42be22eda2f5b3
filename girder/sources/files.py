"""Readers of project files: whole texts, bills with free headers and schedule exports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What headers of a bill are called.
ALIASES = {
    "description": ["description", "item_description", "work_item", "item", "activity", "desc", "name"],
    "quantity": ["quantity", "qty", "no", "number", "count"],
    "unit": ["unit", "uom", "u/m", "unit_of_measure", "measure"],
    "rate": ["rate", "unit_cost", "unit_price", "price", "unit_rate", "cost_per_unit", "cost/unit"],
    "total": ["total", "total_cost", "amount", "line_total", "extended_price", "cost", "value"],
    "section": ["section", "division", "trade", "category", "csi_div", "package", "work_package"],
}
CURRENCIES = "SAR|USD|AED|EUR|GBP|JPY|CNY|AUD|CAD|KWD|QAR|BHD|OMR"
#: Lines of a bill that are looked through for its header, which can stand below titles.
HEADER_LINES = 60


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of each text file below ``path``, one row a file."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def words_of(name: str) -> tuple[str, ...]:
    """The words of a header or of an alias in lower case, without what it says in brackets at its end and a currency last."""
    words = [w.strip(".,:;") for w in re.split(r"[\s/_-]+", re.sub(r"\([^)]*\)\s*$", "", name).lower())]
    words = [w for w in words if w]
    return tuple(words[:-1] if len(words) > 1 and words[-1].upper() in CURRENCIES.split("|") else words)


def holds(words: tuple[str, ...], part: tuple[str, ...]) -> bool:
    return any(words[i : i + len(part)] == part for i in range(len(words) - len(part) + 1))


def resolved(headers: list[str]) -> dict[str, str]:
    """The header that stands for each column of a bill: the best of all pairs of a header and an alias of the column.

    A header that is an alias comes before one that only holds an alias as a part; of those that are, the alias
    listed first counts, of parts the longest; then the header that stands first.
    """
    names = [words_of(h) for h in headers]
    pairs = [
        (column, (1, -k) if name == words_of(alias) else (0, len(alias)), -i)
        for column, aliases in ALIASES.items()
        for k, alias in enumerate(aliases)
        for i, name in enumerate(names)
        if holds(name, words_of(alias))
    ]
    return {column: headers[-max((score, i) for c, score, i in pairs if c == column)[1]] for column in dict.fromkeys(c for c, _, _ in pairs)}


def bill(spark: SparkSession, path: str) -> DataFrame:
    """The columns of one bill in CSV that ALIASES know, figures as numbers (0 where they are none).

    The header is the first line with two such columns among the first HEADER_LINES, which are all that the driver
    reads; the lines up to it are left out by their numbers in the file.
    """
    lines = spark.read.option("multiLine", "true").option("escape", '"').option("header", "false").csv(path)
    first = [[v or "" for v in row] for row in lines.limit(HEADER_LINES).collect()]
    at = next((i for i, row in enumerate(first) if len(resolved(row)) > 1), None)
    taken = resolved(first[at]) if at is not None else {}
    if "description" not in taken:
        raise ValueError("no line of the bill has a header that stands for a description")
    order = {column: first[at].index(header) for column, header in taken.items()}
    # A file of lines that can hold line breaks is one partition, in which these numbers count from 0.
    numbered = lines.withColumn("__line", F.monotonically_increasing_id()).where(F.col("__line") > at)
    named = numbered.select(*(F.col(lines.columns[i]).alias(c) for c, i in order.items()))
    figures = {c: F.coalesce(F.expr(f"try_cast(regexp_replace({c}, '[^0-9.-]', '') AS DOUBLE)"), F.lit(0.0)) for c in ("quantity", "rate", "total") if c in order}
    return named.withColumns(figures)


def schedule_tables(spark: SparkSession, path: str) -> DataFrame:
    """(path, table, row, values) of schedule exports in tabbed text: %T names a table, %F its fields, %R a row.

    ``values`` maps field names to text. A line takes its table and fields from the last %T and %F before it in its file.
    """
    lines = texts(spark, path).select("path", F.posexplode(F.split("text", r"\r?\n")).alias("line", "content"))
    cells = lines.withColumn("cells", F.split("content", "\t")).withColumn("mark", F.col("cells")[0])
    w = Window.partitionBy("path").orderBy("line")
    rest = F.slice("cells", 2, F.size("cells"))
    filled = cells.withColumn("table", F.last(F.when(F.col("mark") == "%T", F.col("cells")[1]), ignorenulls=True).over(w)).withColumn("fields", F.last(F.when(F.col("mark") == "%F", rest), ignorenulls=True).over(w))
    rows = filled.where("mark = '%R' AND fields IS NOT NULL")
    pairs = F.filter(F.arrays_zip(F.col("fields").alias("k"), rest.alias("v")), lambda x: x.k.isNotNull())
    return rows.select("path", "table", F.col("line").alias("row"), F.map_from_entries(pairs).alias("values"))


def networks_of(tables: DataFrame, hours: float = 8.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(activities, links, assignments) of schedule_tables(), with activities by their codes, a network for each file.

    Rows name tasks by internal ids, which two joins turn into codes. Durations are working days by the calendar of the
    task (``hours`` a day where it has none), lags days of ``hours``. Assignments have the resource's name, whether
    it is labour, and its units. Links and assignments of tasks that the file lacks are left out.
    """
    rows = lambda name: tables.where(F.col("table") == name).select(F.col("path").alias("network"), "values")
    field = lambda name: F.col("values")[name]
    number = lambda name: F.coalesce(field(name).try_cast("double"), F.lit(0.0))
    calendars = rows("CALENDAR").select("network", field("clndr_id").alias("clndr"), number("day_hr_cnt").alias("day")).where("day > 0").dropDuplicates(["network", "clndr"])
    tasks = rows("TASK").select("network", field("task_id").alias("task"), field("task_code").alias("activity"), field("clndr_id").alias("clndr"), number("target_drtn_hr_cnt").alias("h"))
    days = F.round(F.col("h") / F.coalesce("day", F.lit(hours))).cast("long")
    activities = tasks.join(calendars, ["network", "clndr"], "left").select("network", "activity", days.alias("duration"))
    code = lambda name, at: tasks.select("network", F.col("task").alias(at), F.col("activity").alias(name))
    kind = F.substring(F.coalesce(field("pred_type"), F.lit("PR_FS")), -2, 2)
    given = rows("TASKPRED").select("network", field("pred_task_id").alias("p"), field("task_id").alias("s"), kind.alias("kind"), F.round(number("lag_hr_cnt") / hours).cast("long").alias("lag"))
    links = given.join(code("pred", "p"), ["network", "p"]).join(code("succ", "s"), ["network", "s"]).select("network", "pred", "succ", "kind", "lag")
    kinds = rows("RSRC").select("network", field("rsrc_id").alias("r"), field("rsrc_short_name").alias("resource"), (field("rsrc_type") == "RT_Labor").alias("labour"))
    used = rows("TASKRSRC").select("network", field("task_id").alias("t"), field("rsrc_id").alias("r"), number("target_qty").alias("units"))
    assignments = used.join(code("activity", "t"), ["network", "t"]).join(kinds, ["network", "r"]).select("network", "activity", "resource", "labour", "units")
    return activities, links, assignments


#: Fields of an activity in an XML schedule, and what they are called here.
XML_FIELDS = {"ID": "activity", "Name": "name", "Start": "start", "Finish": "finish", "Duration": "duration", "TotalFloat": "total_float", "PercentComplete": "percent_complete"}
XML_FIGURES = ("Duration", "TotalFloat", "PercentComplete")


def xml_schedule(spark: SparkSession, path: str) -> DataFrame:
    """(network, activity, name, start, finish, duration, total_float, percent_complete) of the activities in XML schedules, a network for each file.

    Activities are found at any depth and read in parallel with a stated schema; other elements aren't parsed. Absent
    texts are blank, figures that are absent or no numbers are 0.
    """
    fields = ", ".join(f"{f} STRING" for f in XML_FIELDS)
    read = spark.read.format("xml").option("rowTag", "Activity").schema(fields).load(path)
    figure = lambda f: F.coalesce(F.expr(f"try_cast({f} AS DOUBLE)"), F.lit(0.0))
    columns = ((figure(f) if f in XML_FIGURES else F.coalesce(f, F.lit(""))).alias(name) for f, name in XML_FIELDS.items())
    return read.select(F.input_file_name().alias("network"), *columns)
