"""Exports of thread and projection tables: JSON lines, CSV, Markdown and an HTML table.

All are written by the executors as folders of files; only write_html(), which is a page for a
reader, takes a number of rows, and says how many it left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, html_escape, safe_filename, script_json, trim_ws
from ..operators.segmentation import salutation_cap, signature_cap

CSV_COLUMNS = ("thread_id", "message_key", "subject", "date", "from", "to", "cc", "reply_text", "mail_kinds", "event_kinds", "lifecycle_kinds")
PROFILES = ("full", "compact", "canonical", "tree")
#: Columns of canonical messages.
CANONICAL = ("thread_id", "message_key", "uid", "internal_date", "message_id", "in_reply_to", "references", "subject", "date")


def csv_rows(rows: DataFrame) -> DataFrame:
    """The eleven columns, lists joined by '; ' (K04)."""
    lists = {c for c, t in rows.dtypes if t == "array<string>"}
    return rows.select(*(F.array_join(c, "; ").alias(c) if c in lists else F.col(c) for c in CSV_COLUMNS))


def compact(messages: DataFrame) -> DataFrame:
    """Lists replaced by their sizes, as columns named *_count."""
    lists = [c for c, t in messages.dtypes if t.startswith("array<struct")]
    return messages.select(*(F.col(c) for c in messages.columns if c not in lists), *(F.coalesce(F.size(c), F.lit(0)).alias(f"{c}_count") for c in lists))


def canonical_messages(messages: DataFrame) -> DataFrame:
    """Messages of segmentation.with_parts() with capped salutations and signatures, and quoted and forwarded blocks."""
    parts = [salutation_cap(F.col("salutation")).alias("salutation"), F.col("reply").alias("reply_text"), signature_cap(F.col("signature")).alias("signature"), "disclaimers", "quoted", "forwarded"]
    return messages.select(*(c for c in CANONICAL if c in messages.columns), *parts)


def profile(messages: DataFrame, name: str, tree: DataFrame | None = None) -> DataFrame:
    """One row a thread with its messages as structs, in the form of a profile.

    full has every column, compact sizes in place of lists of structs, canonical the parts of
    bodies, tree canonical messages with parent_key and depth of threads.reply_tree(), in walking order.
    """
    if name not in PROFILES:
        raise ValueError(f"unknown profile: {name}")
    rows = {"full": lambda m: m, "compact": compact, "canonical": canonical_messages, "tree": canonical_messages}[name](messages)
    if name == "tree":
        if tree is None:
            raise ValueError("the tree profile needs a reply tree")
        rows = rows.join(tree.select("thread_id", "message_key", "parent_key", "depth", "is_root", "is_orphan"), ["thread_id", "message_key"], "left")
    order = [c for c in ("depth", "date", "message_key") if c in rows.columns]
    rest = [c for c in rows.columns if c not in ("thread_id", *order)]
    return rows.groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("messages"))


def browser_rows(rows: DataFrame) -> DataFrame:
    """The ten columns of the page's own CSV: lists joined by bars, white space in bodies as single blanks."""
    flat = lambda c: F.array_join(c, " | ").alias(c)
    return rows.select("date", flat("from"), flat("to"), flat("cc"), "subject", flat("mail_kinds"), flat("event_kinds"), flat("lifecycle_kinds"), trim_ws(F.regexp_replace("reply_text", f"{WS}+", " ")).alias("body"), "message_key")


def browser_sheet(rows: DataFrame) -> DataFrame:
    """browser_rows() as rows of an HTML table, which spreadsheets open."""
    flat = browser_rows(rows)
    return flat.select(F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), html_escape(F.coalesce(c, F.lit(""))), F.lit("</td>")) for c in flat.columns), F.lit("</tr>")).alias("value"))


def markdown(rows: DataFrame) -> DataFrame:
    """(thread_id, value): a document for each thread, messages by date."""
    mark = F.when(F.col("subject").rlike("(?i)^(?:fwd|fw):"), "Forwarded: ").when(F.col("subject").rlike("(?i)^re:"), "Reply: ").otherwise("")
    body = F.concat_ws("\n", F.concat(F.lit("## "), mark, "subject"), F.lit(""), F.concat(F.lit("- From: "), F.array_join("from", ", ")), F.concat(F.lit("- To: "), F.array_join("to", ", ")), F.concat(F.lit("- Date: "), "date"), F.lit(""), F.col("reply_text"), *_sections(rows), F.lit(""))
    each = rows.groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("date", "message_key", body.alias("body")))).alias("m"))
    text = F.concat(F.lit("# Thread "), F.col("thread_id"), F.lit("\n\n"), F.array_join(F.transform("m", lambda x: x["body"]), "\n"))
    return each.select("thread_id", text.alias("value"))


def _sections(rows: DataFrame) -> list[Column]:
    """Quoted and forwarded blocks and attachments below a message, where the rows have them."""
    out = []
    for name, title in (("quoted", "Quoted"), ("forwarded", "Forwarded"), ("attachments", "Attachments")):
        if name in rows.columns:
            line = (lambda a: F.concat(F.lit("- "), F.coalesce(a["filename"], F.lit("attachment")), F.lit(" ("), a["size"].cast("string"), F.lit(" bytes)"))) if name == "attachments" else (lambda t: F.concat(F.lit("> "), F.replace(t, F.lit("\n"), F.lit("\n> "))))
            out.append(F.when(F.size(name) > 0, F.concat(F.lit(f"\n### {title}\n\n"), F.array_join(F.transform(name, line), "\n\n"))))
    return out


def write_json_array(df: DataFrame, path: str) -> None:
    """One JSON array in one file, rows streamed through the driver a partition at a time."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("[\n")
        for i, r in enumerate(df.select(F.to_json(F.struct(*df.columns)).alias("j")).toLocalIterator()):
            f.write((",\n" if i else "") + r["j"])
        f.write("\n]\n")


def thread_files(threads: DataFrame) -> DataFrame:
    """(name, value): thread_<id>.json and its document for each thread."""
    return threads.select(F.concat(F.lit("thread_"), safe_filename(F.col("thread_id")), F.lit(".json")).alias("name"), F.to_json(F.struct(*threads.columns)).alias("value"))


def write_files(files: DataFrame, folder: str) -> None:
    """Each row's value (text or bytes) as a file of its name in a folder that all executors share, written by them.

    A file is written under another name first and then renamed, so a task that runs twice does no harm.
    """
    import os
    import uuid

    os.makedirs(folder, exist_ok=True)

    def write(rows) -> None:
        for r in rows:
            value = r["value"]
            path = os.path.join(folder, f".{uuid.uuid4().hex}")
            with open(path, "wb") as f:
                f.write(value.encode() if isinstance(value, str) else bytes(value))
            os.replace(path, os.path.join(folder, r["name"]))

    files.select("name", "value").foreachPartition(write)


def load_canonical(spark, path: str) -> DataFrame:
    """Threads that were written as JSON, one row a message."""
    found = spark.read.option("multiLine", True).json(path)
    return found.select("thread_id", F.explode("messages").alias("m")).select("thread_id", "m.*") if "messages" in found.columns else found


def write_dataset(df: DataFrame, path: str, form: str = "jsonl", split: str = "none", mode: str = "errorifexists") -> None:
    """Write as jsonl, json (JSON lines in files by thread), csv, markdown or parquet.

    split='thread' makes a folder for each thread; jsonl with it is an error.
    """
    if form not in ("jsonl", "json", "csv", "markdown", "parquet"):
        raise ValueError(f"unknown format: {form}")
    if form == "jsonl" and split == "thread":
        raise ValueError("jsonl is one stream and can't be split by thread")
    if form == "csv":
        df = csv_rows(df)
    if form == "markdown":
        df = markdown(df)
    out = df.write.mode(mode)
    if split == "thread":
        out = out.partitionBy("thread_id")
    elif form == "markdown":
        out = df.select("value").write.mode(mode)
    if form == "csv":
        out.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    elif form == "markdown":
        out.text(path)
    elif form == "parquet":
        out.parquet(path)
    else:
        out.option("ignoreNullFields", True).json(path)


def html_rows(rows: DataFrame) -> DataFrame:
    """Each row as a table row, escaped in the JVM."""
    cell = lambda c: F.concat(F.lit("<td>"), html_escape(F.coalesce(c, F.lit(""))), F.lit("</td>"))
    flat = csv_rows(rows)
    return flat.select("date", "message_key", F.concat(F.lit("<tr>"), *(cell(F.col(c)) for c in CSV_COLUMNS), F.lit("</tr>")).alias("value"))


def write_html(rows: DataFrame, path: str, most: int = 10_000, links: DataFrame | None = None) -> list[str]:
    """A report as pages of at most so many rows each, by falling date, all rows in all (K06); returns their paths.

    Further pages are path with .2, .3, ... before its ending.  With links, the first page also
    draws them as a graph of threads, messages, people, URLs and days.
    """
    ordered = html_rows(rows).orderBy(F.desc("date"), "message_key").select("value")
    data = "[]" if links is None else "[" + ",".join(r["j"] for r in links.select(script_json(F.to_json(F.struct("source", "target", "kind"))).alias("j")).toLocalIterator()) + "]"
    out: list[str] = []
    page: list[str] = []
    stem, dot, ending = path.rpartition(".")

    def write() -> None:
        name = path if not out else f"{stem}.{len(out) + 1}.{ending}" if dot else f"{path}.{len(out) + 1}"
        graph = GRAPH.replace("DATA", data) if links is not None and not out else ""
        head = "".join(f"<th>{c}</th>" for c in CSV_COLUMNS)
        with open(name, "w", encoding="utf-8") as f:
            f.write(f'<!doctype html><meta charset="utf-8"><title>Mail</title>{graph}<table><thead><tr>{head}</tr></thead><tbody>{"".join(page)}</tbody></table>\n')
        out.append(name)
        page.clear()

    for r in ordered.toLocalIterator():
        if len(page) == most:
            write()
        page.append(r["value"])
    if page or not out:
        write()
    return out


#: Nodes on a circle by kind, lines between them; drawn without a library.
GRAPH = """<canvas id="g" width="900" height="900"></canvas><script type="application/json" id="d">DATA</script><script>
const links = JSON.parse(document.getElementById("d").textContent), pen = document.getElementById("g").getContext("2d");
const ids = [...new Set(links.flatMap(l => [l.source, l.target]))].sort(), place = {};
ids.forEach((id, i) => { const a = 6.2832 * i / ids.length; place[id] = [450 + 420 * Math.cos(a), 450 + 420 * Math.sin(a)]; });
pen.strokeStyle = "rgba(80,80,80,.3)"; links.forEach(l => { pen.beginPath(); pen.moveTo(...place[l.source]); pen.lineTo(...place[l.target]); pen.stroke(); });
const tint = {T: "#333", M: "#06c", P: "#c60", U: "#090", D: "#909"}; ids.forEach(id => { pen.fillStyle = tint[id[0]]; pen.fillRect(place[id][0] - 2, place[id][1] - 2, 4, 4); });
</script>"""


def attachment_name(sha: Column, filename: Column) -> Column:
    return F.concat(sha, F.lit("_"), safe_filename(filename))


def write_attachments(found: DataFrame, path: str, files: bool = False) -> None:
    """(name, bytes) of each content once, as a table or as files; the name with the smallest text of several is kept.

    Equal contents are one before the shuffle as far as a task has met them: first() combines.
    """
    one = found.where("octet_length(bytes) > 0").groupBy("sha256").agg(F.min("filename").alias("filename"), F.first("bytes").alias("bytes"))
    named = one.select(attachment_name(F.col("sha256"), F.col("filename")).alias("name"), "bytes")
    if files:
        write_files(named.withColumnRenamed("bytes", "value"), path)
    else:
        named.write.mode("overwrite").parquet(path)
