"""Recorded inputs: search answers, breach answers, broker catalogs, corpora; and where results go."""

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions import variants as V

BREACHES = "struct<breaches:array<struct<email:string,breach_name:string,severity:string,passwords_included:boolean,exposure_type:string,occurred_at:string,record_count:long>>>"

#: Fixed value: breaches that are reported of an email.
MOST_BREACHES = 25


#: The spellings that recorded and live answers use of a field.
LINK, RESULTS = ("link", "url"), ("results", "organic")
METRICS, BREACH_NAME = ("BreachMetrics", "breach_metrics"), ("name", "breach", "title")
BREACH_DATE, BREACH_CLASSES = ("xposed_date", "breach_date", "date"), ("xposed_data", "data_classes", "dataClasses")


def search_rows(raw: DataFrame, column: str = "json") -> DataFrame:
    """Search answers as rows, recorded (``searches`` of ``results``) or live (one list ``organic``): results without a link go,
    titles default to it, positions count from 1. What else a result has is kept as JSON in ``other``. Answers that aren't JSON have no rows."""
    v = raw.select(V.parsed(F.col(column)).alias("v")).withColumn("f", V.fields(F.col("v")))
    s = v.select(F.explode(F.coalesce(V.items(F.col("f"), "searches"), F.array("v"))).alias("s")).select(V.fields(F.col("s")).alias("s"))
    r = s.select(V.any_text(F.col("s"), "person_id").alias("person_id"), V.any_text(F.col("s"), "query").alias("query"), F.posexplode(V.items(F.col("s"), *RESULTS)).alias("i", "r"))
    x = F.col("r")
    r = r.withColumn("r", V.fields(x)).withColumn("url", V.text(x, *LINK)).filter("url is not null")
    return r.select("person_id", "query", F.coalesce(V.any_text(x, "title"), "url").alias("title"), "url", F.coalesce(V.any_text(x, "snippet"), F.lit("")).alias("snippet"), F.coalesce(V.number(x, "position").cast("int"), F.col("i") + 1).alias("position"),
        F.when(F.col("url").rlike(r"(?i)[.]pdf([?#]|$)"), "pdf").otherwise("html").alias("content_type"), V.rest(x, *LINK, "title", "snippet", "position").alias("other"))


def breach_names(raw: DataFrame, column: str = "json") -> DataFrame:
    """Distinct names of a breach answer, nested lists flattened, blanks and what isn't text dropped; an error answer is a clean result."""
    v = raw.select("email", V.fields(V.parsed(F.col(column))).alias("f"))
    listed = F.flatten(F.transform(V.items(F.col("f"), "breaches"), lambda b: F.coalesce(F.try_variant_get(b, "$", "array<variant>"), F.array(b))))
    names = F.when(V.text(F.col("f"), "Error").isNull(), V.only_texts(listed))
    each = v.select("email", F.array_distinct(F.coalesce(names, F.array().cast("array<string>"))).alias("kept"))
    return each.select("email", F.slice("kept", 1, MOST_BREACHES).alias("names"), F.size("kept").alias("total"))


def breach_details(raw: DataFrame, column: str = "json") -> DataFrame:
    """Details by lower-case name from any spelling of a metrics answer, with the aggregate password flag and the first label of
    risk; ``place`` is the detail's in its answer, ``other`` the JSON of fields that no column has. Details without a name have a null key."""
    m = raw.select("email", V.fields(V.part(V.fields(V.parsed(F.col(column))), *METRICS)).alias("m"))
    strength = lambda k: F.coalesce(V.number(F.col("s"), k), F.lit(0.0)) > 0
    m = m.select("email", V.fields(V.part(F.col("m"), "passwords_strength")).alias("s"), V.items(F.col("m"), "get_details").alias("ds"), V.any_text(V.fields(F.get(V.items(F.col("m"), "risk"), F.lit(0))), "risk_label").alias("risk_label"))
    d = m.select("email", (strength("PlainText") | strength("EasyToCrack")).alias("weak"), "risk_label", F.posexplode_outer("ds").alias("place", "d"))
    x = F.col("d")
    d = d.withColumn("d", V.fields(x))
    return d.select("email", "weak", "risk_label", "place", F.lower(V.text(x, *BREACH_NAME)).alias("key"), V.text(x, *BREACH_DATE).alias("date"), F.coalesce(V.texts(x, *BREACH_CLASSES), F.array().cast("array<string>")).alias("classes"), V.rest(x, *BREACH_NAME, *BREACH_DATE, *BREACH_CLASSES).alias("other"))


def breach_rows(names: DataFrame, details: DataFrame) -> DataFrame:
    """A discovery row for each breach of an email; its own data classes decide about credentials, the aggregate only where there are none.

    Of details of one name the last of the answer stands; of equal places the larger."""
    n = names.select("email", "total", F.explode("names").alias("name")).withColumn("key", F.lower("name"))
    whole = details.groupBy("email").agg(F.bool_or("weak").alias("aggregate"), F.max("risk_label").alias("risk_label"))
    last = details.filter("key is not null").groupBy("email", "key").agg(F.max(F.struct("place", "date", "classes", "other")).alias("d"))
    both = n.join(last, ["email", "key"], "left").join(whole, "email", "left").select("*", "d.date", "d.classes", "d.other")
    own = F.exists("classes", lambda c: c.rlike("(?i)passw"))
    classes = F.when(F.size("classes") > 0, F.concat(F.lit(" Exposed data: "), F.array_join("classes", ", "), F.lit("."))).otherwise(F.lit(""))
    credential = F.when(F.col("classes").isNotNull(), own).otherwise(F.coalesce("aggregate", F.lit(False)))
    # fixed values: the wording of title and snippet
    title = F.concat(F.lit("Breach record: "), "name")
    snippet = F.concat(F.lit('Email address appears in the "'), "name", F.lit('" breach record.'), classes)
    return both.select("email", "name", "total", "date", credential.alias("credential"), title.alias("title"), snippet.alias("snippet"), "risk_label", "other")


def breach_summary(raw: DataFrame, column: str = "json") -> DataFrame:
    """By email: breaches, those with passwords, and the worst severity (the first of equals)."""
    b = raw.select(F.posexplode(F.from_json(column, BREACHES)["breaches"]).alias("i", "b")).select("i", "b.*")
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in ("low", "medium", "high", "critical")]), F.lower("severity")), F.lit(0))
    return b.groupBy(F.lower("email").alias("email")).agg(F.count("*").alias("breaches"), F.count_if("passwords_included").alias("with_passwords"), F.initcap(F.max_by(F.lower("severity"), F.struct(rank, -F.col("i")))).alias("risk_label"))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """A broker catalog from JSON: a list, or an object with one. Positions follow the files' names and the order in each."""
    shape = "array<struct<name:string,domain:string,category:string,optOutUrl:string,instructions:string,domains:array<string>>>"
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.coalesce(F.from_json("value", f"struct<brokers:{shape}>")["brokers"], F.from_json("value", shape)).alias("bs"))
    each = raw.select("file", F.posexplode("bs").alias("i", "b")).select("file", "i", "b.*")
    files = raw.groupBy("file").agg(F.sum(F.size("bs")).alias("n"))
    files = files.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = each.join(F.broadcast(files), "file").withColumn("position", (F.col("before") + F.col("i")).cast("int"))
    other = F.col("domains") if "domains" in rows.columns else F.array().cast("array<string>")
    return rows.select("name", "domain", F.col("optOutUrl").alias("opt_out_url"), F.coalesce(other, F.array().cast("array<string>")).alias("domains"), "position", "category", "instructions")


def breach_lists(raw: DataFrame, column: str = "json") -> DataFrame:
    """By address: the distinct names of its breaches, how many of them expose passwords, and their details, by name.

    Of a breach that is recorded twice for an address the details with the larger severity, then type, stand."""
    b = raw.select(F.explode(F.from_json(column, BREACHES)["breaches"]).alias("b")).select("b.*")
    detail = F.struct("severity", "exposure_type", "occurred_at", "record_count", "passwords_included")
    one = b.groupBy(F.lower("email").alias("email"), F.col("breach_name").alias("name")).agg(F.max(detail).alias("d"))
    return one.groupBy("email").agg(F.array_sort(F.collect_list("name")).alias("names"), F.count_if("d.passwords_included").alias("with_passwords"), F.array_sort(F.collect_list(F.struct("name", "d.*"))).alias("details"))


def ner_rows(raw: DataFrame, column: str = "json") -> DataFrame:
    """Recorded answers of a recognizer as rows: source, label, text, score, start, end; the answers nest documents and their entities."""
    shape = "struct<extracted_from:array<struct<source:string,person_id:string,entities:array<struct<text:string,label:string,score:double,start:int,end:int>>>>>"
    each = raw.select(F.explode(F.from_json(column, shape)["extracted_from"]).alias("x")).select("x.source", "x.person_id", F.explode("x.entities").alias("e"))
    return each.select("source", "person_id", "e.label", "e.text", "e.score", "e.start", "e.end")


def ground_truth(raw: DataFrame, column: str = "json") -> DataFrame:
    """Profiles of a ground truth in either form: one ``target_profile``, or a list ``target_profiles``; with the form's version."""
    profile = "struct<id:string,name:string,email:string,phone:string,username:string,organization:string,location:string,city:string,state:string>"
    x = F.from_json(column, f"struct<target_profile:{profile},target_profiles:array<{profile}>>")
    many = raw.select(x.alias("x")).withColumn("version", F.when(F.col("x.target_profiles").isNotNull(), 2).otherwise(1))
    listed = F.coalesce("x.target_profiles", F.when(F.col("x.target_profile").isNotNull(), F.array("x.target_profile")))
    return many.select("version", F.explode(listed).alias("p")).select("version", "p.*")


def report(summary: DataFrame, by_person: DataFrame, mismatched: DataFrame, path: str) -> None:
    """An evaluation report as JSON lines: a ``summary`` row, a row for each person and one for each entry that differs, each
    named by its ``kind``. Rows are written where they are, however many entries differ."""
    parts = [df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("value")) for kind, df in (("summary", summary), ("person", by_person), ("mismatch", mismatched))]
    parts[0].unionByName(parts[1]).unionByName(parts[2]).write.mode("overwrite").partitionBy("kind").text(path)


def corpus(spark: SparkSession, path: str, fields: dict[str, tuple[str, ...]], multi_line: bool = True) -> DataFrame:
    """Sparse JSON of a folder, a file (or, without ``multi_line``, a line) an entry, with the name of its file: the texts of
    ``fields``, each from the first of its spellings that there is, and all other fields as JSON in ``other``. What isn't
    an object has no fields."""
    raw = spark.read.option("singleVariantColumn", "value").option("multiLine", multi_line).json(path).select(V.fields(F.col("value")).alias("fields"), F.col("_metadata.file_name").alias("file"))
    v = F.col("fields")
    return raw.select(*[V.text(v, *names).alias(name) for name, names in fields.items()], V.rest(v, *[n for names in fields.values() for n in names]).alias("other"), "file")


def expected_totals(raw: DataFrame, column: str = "json") -> DataFrame:
    """How many results of each label ground truths expect: version, label, n.

    Version 2 counts by person (``expected_results``), version 1 lists them: by kind what is confirmed, and what is potential."""
    v = raw.select(V.fields(V.parsed(F.col(column))).alias("v"))
    counts, kinds = V.part(F.col("v"), "expected_results"), V.part(F.col("v"), "expected_confirmed")
    people = v.select(F.explode(F.try_variant_get(counts, "$", "map<string,map<string,long>>")).alias("person", "c")).select(F.lit(2).alias("version"), F.explode("c").alias("label", "n"))
    lists = v.select(F.explode(F.try_variant_get(kinds, "$", "map<string,array<variant>>")).alias("kind", "xs")).select(F.lit(1).alias("version"), F.concat(F.lit("confirmed_"), "kind").alias("label"), F.size("xs").cast("long").alias("n"))
    rest = v.select(F.lit(1).alias("version"), F.lit("potential").alias("label"), F.size(V.items(F.col("v"), "expected_potential")).cast("long").alias("n")).filter("n >= 0")
    return people.unionByName(lists).unionByName(rest).groupBy("version", "label").agg(F.sum("n").alias("n"))


def integrity(tables: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """Rows of each named input against the least expected."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("input"), "n", (F.col("n") >= least).alias("ok")) for name, (df, least) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def append(rows: DataFrame, path: str) -> None:
    """Discovery rows, by scan and source."""
    rows.write.mode("append").partitionBy("scan_id", "source").parquet(path)


def publish(rows: DataFrame, root: str, version: int) -> str:
    """A snapshot of the whole state under its version; readers take the largest version that is complete."""
    path = f"{root}/version={version:010d}"
    rows.write.mode("overwrite").parquet(path)
    return path


class RecordedSearch(DataSource):
    """Folders of recorded search answers as a source: ``spark.read.format("recorded_search").load(folder)``, or ``readStream``.

    A row for each result with a link: person_id, query, title (the link where there is none), url, snippet, position. A
    stream takes files in order of their time of change, then name; its offset is the last file taken, so it goes on after a
    stop without loss or repeat. Files are written once."""

    @classmethod
    def name(cls) -> str:
        return "recorded_search"

    def schema(self) -> str:
        return "person_id string, query string, title string, url string, snippet string, position int"

    def reader(self, schema) -> DataSourceReader:
        return _Files(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _NewFiles(self.options["path"])


def _listed(path: str) -> list[tuple[int, str]]:
    """(time of change, path) of the JSON files of a folder, in order."""
    from pyarrow import fs

    where, top = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return sorted((f.mtime_ns, f.path) for f in where.get_file_info(fs.FileSelector(top, recursive=True)) if f.path.endswith(".json"))


def _results(root: str, path: str):
    from pyarrow import fs

    where, _ = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
    with where.open_input_stream(path) as f:
        for s in json.loads(f.read()).get("searches") or []:
            for i, r in enumerate(s.get("results") or [], 1):
                if r.get("url"):
                    yield s.get("person_id"), s.get("query"), r.get("title") or r["url"], r["url"], r.get("snippet") or "", r.get("position") or i


class _Files(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for _, f in _listed(self.path)]

    def read(self, partition: InputPartition):
        return _results(self.path, partition.value)


class _NewFiles(DataSourceStreamReader):
    """Offsets are {"time", "file"} of the last file taken."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"time": -1, "file": ""}

    def latestOffset(self) -> dict:
        files = _listed(self.path)
        return {"time": files[-1][0], "file": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        lo, hi = (start["time"], start["file"]), (end["time"], end["file"])
        return [InputPartition(f[1]) for f in _listed(self.path) if lo < f <= hi] or [InputPartition(None)]

    def read(self, partition: InputPartition):
        return _results(self.path, partition.value) if partition.value else iter(())
