"""Scans of results, sidecars, trees, paged services and registries, and the sinks that write what they read."""

from __future__ import annotations

import json
import posixpath
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from losslens.operators.mixing import sampled
from losslens.sources.files import read_files
from losslens.sources.saved import numbered, saved

#: What stands around a model's name in the file names of its results: a pattern before, a text after.
RESULT_PREFIX, RESULT_SUFFIX = ".*_gens_model_", "_verified.jsonl"


def write_named(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> int:
    """One file for each row, under the row's name (folders allowed) with its content (text or binary); returns their number.

    A file is written under another name and then moved, so that a task that is
    run again, or twice at once, leaves whole files only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        n = 0
        for batch in batches:
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = posixpath.join(root, path)
                files.create_dir(posixpath.dirname(target), recursive=True)
                passing = posixpath.join(posixpath.dirname(target), f"_{uuid.uuid4().hex}")
                with files.open_output_stream(passing) as f:
                    f.write(body)
                files.move(passing, target)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    written = rows.select(name, F.col(content).cast("binary")).mapInArrow(run, "n long")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_artifacts(rows: DataFrame, folder: str) -> int:
    """Raw artifacts: an input and an output file for each sample, and a sidecar of counts where the codec has one.

    rows: id, algo, category, input, output, sidecar (JSON or null), kind (of
    the sidecar, such as freq or codebook).
    """
    stem = F.format_string("%03d_%s", "id", "category")
    place = lambda part, tail: F.concat("algo", F.lit(f"/{part}/"), stem, tail)
    files = F.array(
        F.struct(place("input", F.lit(".txt")).alias("name"), F.col("input").alias("content")),
        F.struct(place("output", F.lit(".txt")).alias("name"), F.col("output").alias("content")),
        F.struct(place("output", F.concat(F.lit("_"), "kind", F.lit(".json"))).alias("name"), F.col("sidecar").alias("content")),
    )
    return write_named(rows.select(F.explode(files).alias("f")).select("f.*").where("content is not null"), folder)


def whole_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, text) of whole files; a folder is read with all below it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return found.select("path", F.decode("content", "UTF-8").alias("text"))


def with_sidecars(rows: DataFrame, id_col: str, folder: str, *kinds: str) -> DataFrame:
    """Rows with one column for each kind: the text of the sidecar whose name begins with the row's number, ``{}`` where there is none, the first by name of several."""
    files = whole_files(rows.sparkSession, folder)
    for kind in kinds:
        number = F.regexp_extract("path", rf"/(\d+)_[^/]*_{kind}\.json$", 1)
        mine = files.where(number != "").groupBy(number.cast("long").alias("_number")).agg(F.min_by("text", "path").alias("_text"))
        rows = rows.join(mine, F.col(id_col) == F.col("_number"), "left").withColumn(kind, F.coalesce("_text", F.lit("{}"))).drop("_number", "_text")
    return rows


def lines_of(spark: SparkSession, paths: list[str], recursive: bool = False, pattern: str = "*") -> DataFrame:
    """(path, value) of the lines that aren't blank."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern)
    return reader.text(paths).select(F.col("_metadata.file_path").alias("path"), "value").where(F.trim("value") != "")


def parsed_lines(lines: DataFrame, schema: str) -> DataFrame:
    """path and the fields of lines that are JSON; other lines are left out."""
    row = lines.select("path", F.from_json("value", schema).alias("row"), F.expr("try_parse_json(value)").alias("any"))
    return row.where(F.col("any").isNotNull()).select("path", "row.*")


def algo_and_model(path: Column) -> list[Column]:
    """A result file's folder, and its name without what stands around the model and the sampling marks."""
    name = F.regexp_replace(F.replace(F.substring_index(path, "/", -1), F.lit(RESULT_SUFFIX), F.lit("")), f"^{RESULT_PREFIX}", "")
    return [F.element_at(F.split(path, "/"), -2).alias("algo"), F.regexp_replace(name, r"_temp_[\d.]+_n\d+$", "").alias("model")]


def read_verified(spark: SparkSession, patterns: list[str], schema: str) -> DataFrame:
    """algo, model, path and the rows of all result files that the globs name; a pattern without a match is an error only if it is a plain path."""
    found = []
    for pattern in patterns:
        place = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
        found += [f.getPath().toString() for f in files or []] or ([] if any(c in pattern for c in "*?[{") else [pattern])
    if not found:
        return spark.createDataFrame([], f"algo string, model string, path string, {schema}")
    rows = parsed_lines(lines_of(spark, sorted(set(found))), schema)
    return rows.select(*algo_and_model(F.col("path")), "*")


def result_files(paths: DataFrame, path: str = "path", holds: tuple[str, ...] = ()) -> DataFrame:
    """Generation files still to be verified: no ``_verified`` in the name, and all the given parts."""
    name = F.substring_index(path, "/", -1)
    keep = ~F.contains(name, F.lit("_verified"))
    for part in holds:
        keep &= F.contains(name, F.lit(part))
    return paths.where(keep)


def tree_usage(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """Requests and estimated tokens by model over all JSON line files below a folder; models with a slash in their name are local and left out."""
    rows = parsed_lines(lines_of(spark, [folder], recursive=True, pattern=pattern), "model string, messages array<struct<content: string>>, output string")
    tokens = lambda t: F.greatest(F.lit(1), F.expr(f"length({t}) div 4"))
    api = rows.where(F.length("model") > 0).where(~F.contains("model", F.lit("/")))
    said = api.select("model", F.array_join(F.transform(F.coalesce("messages", F.array().cast("array<struct<content:string>>")), lambda m: F.coalesce(m["content"], F.lit(""))), " ").alias("asked"), F.coalesce("output", F.lit("")).alias("answered"))
    return said.groupBy("model").agg(F.count("*").alias("requests"), F.sum(tokens("asked")).alias("input_tokens"), F.sum(tokens("answered")).alias("output_tokens"))


class Pages:
    """A service that answers page by page: ``data``, ``has_more`` and ``next_page``; PermissionError where it says 403."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def fetch(self, page: str | None) -> dict:
        raise NotImplementedError


class FolderPages(Pages):
    """The pages of a service as files: ``first.json``, then by name."""

    def fetch(self, page: str | None) -> dict:
        files, root = fs.FileSystem.from_uri(self.options["path"])
        with files.open_input_stream(posixpath.join(root, f"{page or 'first'}.json")) as f:
            found = json.loads(f.read())
        if found.get("status") == 403:
            raise PermissionError(found.get("message", "403"))
        return found


class HttpPages(Pages):
    """The pages of a web service: options ``url``, ``key`` and ``query`` (a query string)."""

    def fetch(self, page: str | None) -> dict:
        query = urllib.parse.parse_qsl(self.options.get("query", "")) + ([("page", page)] if page else [])
        asked = urllib.request.Request(f"{self.options['url']}?{urllib.parse.urlencode(query)}", headers={"Authorization": f"Bearer {self.options.get('key', '')}"})
        try:
            with urllib.request.urlopen(asked, timeout=30) as said:
                return json.load(said)
        except urllib.error.HTTPError as e:
            if e.code == 403:
                raise PermissionError(e.read().decode(errors="replace")) from e
            raise


CLIENTS = {"folder": FolderPages, "http": HttpPages}


class PagedReader(DataSourceReader):
    """Follows the cursor from page to page: one partition, as each page names the next."""

    def __init__(self, client: Pages):
        self.client = client

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page, more = None, True
        while more:
            body = self.client.fetch(page)
            yield from usage_rows(body.get("data", []))
            page = following(body)
            more = page is not None


def usage_rows(buckets: list[dict]) -> Iterator[tuple]:
    for bucket in buckets:
        for r in bucket.get("results", []):
            yield bucket["start_time"], r.get("model"), *(int(r.get(k) or 0) for k in ("num_model_requests", "input_tokens", "input_cached_tokens", "output_tokens"))


def following(body: dict) -> str | None:
    """The cursor of the page after this one, if there is one."""
    return (body.get("next_page") or None) if body.get("has_more") else None


class PagePart(InputPartition):
    """Buckets ``begin`` to ``end`` (None: all that are left) of a page."""

    def __init__(self, page: str | None, begin: int, end: int | None):
        self.page, self.begin, self.end = page, begin, end


class PagedStreamReader(DataSourceStreamReader):
    """The service as a stream: an offset is a page's cursor and how many of its buckets are read.

    The driver follows the cursors to the newest page, from where it was last, and
    keeps no bucket; each page between two offsets is a partition, fetched by its
    task.  The last page is read on when it has grown.
    """

    def __init__(self, client: Pages):
        self.client, self.at = client, None

    def initialOffset(self) -> dict:
        return {"page": None, "buckets": 0}

    def _pages(self, page: str | None) -> Iterator[tuple[str | None, int]]:
        """Cursors from this one on, with each page's number of buckets."""
        while True:
            body = self.client.fetch(page)
            yield page, len(body.get("data", []))
            if following(body) is None:
                return
            page = following(body)

    def latestOffset(self) -> dict:
        page, n = list(self._pages(self.at))[-1]
        self.at = page
        return {"page": page, "buckets": n}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts = []
        for page, n in self._pages(start["page"]):
            begin = start["buckets"] if page == start["page"] else 0
            stop = end["buckets"] if page == end["page"] else n
            if stop > begin:
                parts.append(PagePart(page, begin, stop))
            if page == end["page"]:
                return parts
        raise ValueError(f"no page {end['page']} after {start['page']}")

    def read(self, partition: PagePart) -> Iterator[tuple]:
        return usage_rows(self.client.fetch(partition.page).get("data", [])[partition.begin : partition.end])


class PagedUsage(DataSource):
    """spark.read.format("paged_usage").option("client", "folder" or "http"): usage by time bucket and model."""

    @classmethod
    def name(cls) -> str:
        return "paged_usage"

    def schema(self) -> str:
        return "start long, model string, requests long, input_tokens long, cached_tokens long, output_tokens long"

    def client(self) -> Pages:
        return CLIENTS[self.options.get("client", "folder")](dict(self.options))

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.client())

    def streamReader(self, schema) -> PagedStreamReader:
        return PagedStreamReader(self.client())


def read_pages(spark: SparkSession, **options: str) -> DataFrame:
    spark.dataSource.register(PagedUsage)
    return spark.read.format("paged_usage").options(**options).load()


def stream_pages(spark: SparkSession, **options: str) -> DataFrame:
    spark.dataSource.register(PagedUsage)
    return spark.readStream.format("paged_usage").options(**options).load()


def write_pages(buckets: DataFrame, folder: str, per_page: int = 7) -> int:
    """Usage by ``start_time`` and model laid out as a service's pages (``FolderPages``): returns how many buckets there are.

    Buckets are numbered range by range and each page is written by a task; the
    driver gets one count of each range.
    """
    fields = [c for c in buckets.columns if c != "start_time"]
    daily = buckets.groupBy("start_time").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("results"))  # the models of a bucket
    placed = saved(numbered(daily.select("start_time", F.to_json(F.struct("start_time", "results")).alias("body")), "start_time"), "buckets")
    total = placed.count()
    if total == 0:
        placed = buckets.sparkSession.createDataFrame([(0, None)], "n long, body string")
    last = max(0, total - 1) // per_page
    page = F.expr(f"n div {per_page}")
    pages = placed.groupBy(page.alias("page")).agg(F.array_sort(F.collect_list(F.struct("n", "body"))).alias("b"))  # per_page rows
    name = F.when(F.col("page") == 0, "first").otherwise(F.concat(F.lit("p"), F.col("page").cast("string")))
    more = F.when(F.col("page") < last, F.concat(F.lit('], "has_more": true, "next_page": "p'), (F.col("page") + 1).cast("string"), F.lit('"}'))).otherwise('], "has_more": false}')
    body = F.concat(F.lit('{"data": ['), F.array_join(F.transform("b", lambda x: x["body"]), ", "), more)
    write_named(pages.select(F.concat(name, F.lit(".json")).alias("name"), body.alias("content")), folder)
    return total


def yaml_registry(spark: SparkSession, path: str, key: str = "models") -> DataFrame:
    """id, size, category (text, unknown where missing) and active of the list under ``key`` of a YAML file; entries without an id are left out, of equal ids the last counts."""
    try:
        import yaml
    except ImportError as e:
        raise ValueError("reading YAML needs the yaml package") from e

    found = spark.read.format("binaryFile").load(path).select("content").first()
    entries = (yaml.safe_load(bytes(found.content)) or {}).get(key, [])
    if not isinstance(entries, list):
        raise ValueError(f"{path}: '{key}' must be a list")
    rows = {e["id"]: (e["id"], str(e.get("size", "unknown")), str(e.get("category", "unknown")), bool(e.get("active", False))) for e in entries if e.get("id")}
    return spark.createDataFrame(list(rows.values()), "id string, size string, category string, active boolean")


#: Where a registered dataset may come from, the first that its entry names counts.
PLACES = (("hub", "hf_hub_url"), ("hub", "ms_hub_url"), ("hub", "om_hub_url"), ("script", "script_url"), ("cloud", "cloud_file_name"), ("file", "file_name"))
#: Roles of columns, and the names they have unless an entry says otherwise; then roles that only an entry names.
COLUMNS = {"prompt": "instruction", "query": "input", "response": "output", "messages": "conversations"}
MORE_COLUMNS = ("history", "system", "tools", "images", "videos", "audios", "chosen", "rejected", "kto_tag")
#: Fields of a message and names of its speakers, unless an entry's tags say otherwise.
TAGS = {"role_tag": "from", "content_tag": "value", "user_tag": "human", "assistant_tag": "gpt", "observation_tag": "observation", "function_tag": "function_call", "system_tag": "system"}
SPEAKERS = {"user_tag": "user", "assistant_tag": "assistant", "observation_tag": "observation", "function_tag": "function", "system_tag": "system"}


def dataset_entry(spark: SparkSession, folder: str, name: str) -> tuple[str, str, dict]:
    """(place, name there, entry) of a dataset in the folder's ``dataset_info.json``."""
    found = spark.read.format("binaryFile").load(f"{folder}/dataset_info.json").select("content").first()
    entries = json.loads(bytes(found.content))
    if name not in entries:
        raise ValueError(f"Undefined dataset {name} in dataset_info.json.")
    place, key = next((p, k) for p, k in PLACES if k in entries[name])
    return place, entries[name][key], entries[name]


def tagged_messages(messages: Column, tags: dict[str, str]) -> Column:
    """Messages as role and content, by the entry's tags; a speaker that no tag names has a null role."""
    tags = TAGS | tags
    role = lambda m: F.create_map(*[F.lit(x) for tag, name in SPEAKERS.items() for x in (tags[tag], name)])[m[tags["role_tag"]]]
    return F.transform(messages, lambda m: F.struct(role(m).alias("role"), m[tags["content_tag"]].alias("content")))


def load_dataset(spark: SparkSession, folder: str, name: str, schema: str | None = None, stage: str = "sft", seed: int = 42) -> DataFrame:
    """The dataset's rows under the names of their roles; ranking data is for stage ``rm`` only, and that stage takes no other.

    An entry may name a ``split`` (a folder below the dataset's), its columns,
    the ``sharegpt`` formatting with its tags, and ``num_samples``: so many rows are
    drawn, more than there are by drawing again.  Only files can be read here; the
    other places need a network.
    """
    place, where, entry = dataset_entry(spark, folder, name)
    if bool(entry.get("ranking")) != (stage == "rm"):
        raise ValueError(f"dataset {name} is not applicable in stage {stage}")
    if place != "file":
        raise ValueError(f"dataset {name} comes from a {place}, which needs a network")
    kind = entry.get("formatting", "alpaca")
    if kind not in ("alpaca", "sharegpt"):
        raise ValueError(f"no formatting {kind}")
    rows = read_files(spark, "/".join(filter(None, (folder, where, entry.get("split")))), schema)
    if entry.get("num_samples"):
        keyed = saved(rows.withColumn("_row", F.monotonically_increasing_id()), "dataset")
        rows = sampled(keyed, "_row", entry["num_samples"], seed).drop("_row", "sample")
    given = {role: c for role, c in entry.get("columns", {}).items() if role in COLUMNS or role in MORE_COLUMNS or role not in TAGS}
    named = {role: c for role, c in (COLUMNS | given).items() if c in rows.columns}
    column = lambda role, c: tagged_messages(F.col(f"`{c}`"), entry.get("tags", {})) if role == "messages" and kind == "sharegpt" else F.col(f"`{c}`")
    return rows.select(*[column(role, c).alias(role) for role, c in named.items()])


def read_choices(spark: SparkSession, path: str) -> DataFrame:
    """Multiple-choice questions from CSV files without a header."""
    return spark.read.schema("question string, A string, B string, C string, D string, answer string").options(header="false", escape='"', multiLine="true").csv(path)


def write_predictions(rows: DataFrame, path: str) -> None:
    """JSON lines of prompt, predict and label."""
    rows.select("prompt", "predict", "label").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def dataset_card(spark: SparkSession, folder: str, title: str) -> str:
    """A card in Markdown: how many files and bytes lie below a folder, by codec and part, and by codec and extension; no file is opened.

    The driver gets one row for each codec, part and extension, and eight names.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    parts = F.split(F.substring_index("path", folder.rstrip("/").removeprefix("file://") + "/", -1), "/")
    rows = listed.select(F.array_join(parts, "/").alias("name"), parts[0].alias("algo"), parts[1].alias("part"), F.substring_index("path", ".", -1).alias("ext"), "length")
    counts = rows.groupBy("algo", "part", "ext").agg(F.count("*").alias("n"), F.sum("length").alias("bytes")).collect()
    first = [r.name for r in rows.orderBy("name").limit(8).collect()]

    def table(head: str, key) -> str:
        sums: dict[tuple, int] = {}
        for r in counts:
            sums[key(r)] = sums.get(key(r), 0) + r.n
        return f"| Algorithm | {head} | File count |\n|---|---|---:|\n" + "\n".join(f"| `{a}` | `{b}` | {n} |" for (a, b), n in sorted(sums.items()))

    total, size = sum(r.n for r in counts), sum(r.bytes for r in counts)
    return "\n\n".join([
        f"# {title}", f"- Total files: `{total}`\n- Total size: `{size / 1e9:.3f} GB`", "### Folder Breakdown", table("Split", lambda r: (r.algo, r.part)),
        "### File Type Breakdown", table("Extension", lambda r: (r.algo, "." + r.ext)), "### Example Paths", "\n".join(f"- `{n}`" for n in first),
    ])




def with_found_media(rows: DataFrame, media: str, folder: str, out: str = "paths") -> DataFrame:
    """Rows with the paths of their media (an array of names): below the folder where such a file is there, else as they are named.

    Only names are listed.  A row's media keep their order; it needs none.
    """
    there = rows.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    base = folder.rstrip("/").removeprefix("file://")
    known = there.select(F.substring_index("path", base + "/", -1).alias("_name"), F.lit(True).alias("_there"))
    keyed = rows.withColumn("_row", F.monotonically_increasing_id())
    asked = keyed.select("_row", F.posexplode(media).alias("_at", "_name")).join(known, "_name", "left")
    path = F.when(F.col("_there"), F.concat(F.lit(base + "/"), F.col("_name"))).otherwise(F.col("_name"))
    found = asked.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", path.alias("_path")))).alias("_p"))
    paths = F.coalesce(F.transform("_p", lambda p: p["_path"]), F.array().cast("array<string>"))
    return keyed.join(found, "_row", "left").withColumn(out, paths).drop("_row", "_p")
