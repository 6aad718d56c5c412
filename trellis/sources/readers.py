"""Readers: chat exports, Markdown, notes, paper records and source code to rows of nodes.

Files are read by Spark (so any store works) and parsed with JSON functions or in Arrow batches.
"""

from __future__ import annotations

import ast
import io
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_line_title

c = F.col

EXPORT_A = "uuid string, name string, created_at string, chat_messages array<struct<uuid:string,sender:string,text:string,created_at:string>>"

# Languages by file extension.
LANGUAGES = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "pyi": "python", "c": "c", "h": "c", "md": "markdown", "rst": "rst"}


def chat_turns_a(spark: SparkSession, path: str) -> DataFrame:
    """(conv_id, name, turn, role, text) of an export that is an array of conversations with their messages."""
    return turns_of_lists(spark.read.schema(EXPORT_A).json(path, multiLine=True))


def turns_of_lists(conversations: DataFrame) -> DataFrame:
    """The turns of conversations with the fields EXPORT_A."""
    m = conversations.select(c("uuid").alias("conv_id"), "name", F.posexplode("chat_messages").alias("turn", "m"))
    role = F.when(c("m.sender") == "human", "user").otherwise(c("m.sender"))
    return m.select("conv_id", "name", "turn", role.alias("role"), c("m.text").alias("text"))


def _content(content: dict) -> str | None:
    """What a message of the tree export says, by its content type; None for what is skipped."""
    kind, text = content.get("content_type") or "text", content.get("text")
    parts = content.get("parts")
    if kind == "text" and parts is not None:
        said = "\n".join(p for p in parts if isinstance(p, str))
        return said if said.strip() else None
    if kind == "multimodal_text" and parts is not None:
        said = [p for p in parts if isinstance(p, str) and p.strip()]
        images = sum(isinstance(p, dict) for p in parts)
        said += [f"[{images} image(s) attached]"] if images else []
        return "\n".join(said) or None
    if text is not None and kind == "code":
        return f"```{content.get('language') or ''}\n{text}\n```"
    if text is not None and kind == "tether_quote":
        return f"> {text}\n> — {content.get('url') or 'source'}"
    if text is not None and kind == "execution_output":
        return f"Output:\n```\n{text}\n```"
    return content.get("content") if kind == "reasoning_recap" else None


def linear_messages(mapping: dict, current: str | None) -> list[tuple[str, str]]:
    """(role, text) along the branch of a message tree that leads to the current node, else the first."""
    wanted, at = set(), current
    while at in mapping and at not in wanted:
        wanted.add(at)
        at = mapping[at].get("parent")
    out, seen = [], set()
    at = next((k for k in sorted(mapping) if mapping[k].get("parent") is None), None)
    while at in mapping and at not in seen:
        seen.add(at)
        node = mapping[at]
        message = node.get("message") or {}
        role = (message.get("author") or {}).get("role")
        text = _content(message.get("content") or {}) if message else None
        if text is not None and role in ("user", "assistant"):
            out.append((role, text))
        children = node.get("children") or []
        at = next((x for x in children if x in wanted), children[0] if children else None)
    return out


def chat_turns_b(spark: SparkSession, path: str) -> DataFrame:
    """(conv_id, name, turn, role, text) of an export whose conversations are trees of messages."""
    # an element of the array is one record; its text is parsed in the worker
    return turns_of_trees(spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("record")))


def turns_of_trees(records: DataFrame) -> DataFrame:
    """The turns of conversations that are JSON texts (record), each with its tree of messages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["record"]:
                r = json.loads(text)
                conv = r.get("conversation_id") or r.get("id")
                rows += [(conv, r.get("title"), k, role, said) for k, (role, said) in enumerate(linear_messages(r.get("mapping") or {}, r.get("current_node")))]
            yield pd.DataFrame(rows, columns=["conv_id", "name", "turn", "role", "text"])

    return records.select("record").mapInPandas(run, "conv_id string, name string, turn int, role string, text string")


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, content): the first heading of the first level is the title, else the file's name."""
    rows = spark.read.text(path, wholetext=True).select(c("_metadata.file_path").alias("path"), c("value").alias("content"))
    heading = F.trim(F.regexp_extract("content", r"(?m)^\s*# (.*)$", 1))
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "")
    return rows.select("path", F.when(F.length(heading) > 0, heading).otherwise(name).alias("title"), "content")


def _note(raw: dict) -> tuple[str, str, int, bool] | None:
    lines = [f"- [{'x' if x.get('isChecked') else ' '}] {x.get('text', '')}" for x in raw.get("listContent") or []]
    body = "\n".join(x for x in [raw.get("textContent") or "", *lines] if x)
    title = raw.get("title") or ""
    if raw.get("isTrashed") or not (title.strip() or body.strip()):
        return None
    return title.strip() or body.strip().split("\n")[0][:60], body, int(raw.get("createdTimestampUsec") or 0) // 1000, bool(raw.get("isPinned"))


def notes(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """(title, content, created_at, is_pinned) of the notes in zipped takeouts, without trashed and
    empty ones, each (title, created_at) once and none that is known."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    found = [_note(json.loads(z.read(n))) for n in sorted(z.namelist()) if n.endswith(".json") and "/Keep/" in f"/{n}"]
                yield pd.DataFrame([x for x in found if x], columns=["title", "content", "created_at", "is_pinned"])

    out = files.mapInPandas(run, "title string, content string, created_at long, is_pinned boolean").dropDuplicates(["title", "created_at"])
    if known is not None:
        k = known.select(c("title").alias("__t"), c("created_at").alias("__c"))
        out = out.join(k, (c("title") == c("__t")) & (c("created_at") == c("__c")), "left_anti")
    return out


PAPER = """id string, mainTitle string, descriptions array<string>, publicationDate string, publisher string, source array<struct<name:string>>,
 authors array<struct<fullName:string,pid:struct<id:struct<scheme:string,value:string>>>>, pids array<struct<scheme:string,value:string>>,
 subjects array<struct<subject:struct<scheme:string,value:string>>>, bestAccessRight struct<code:string>,
 instances array<struct<accessRight:struct<code:string,label:string>,urls:array<string>>>"""


def papers(pages: DataFrame, column: str = "json") -> DataFrame:
    """Papers of API pages {results: [...]}: first description, DOI, ORCIDs, open-access links, PDF ones preferred."""
    r = pages.select(F.explode(F.from_json(column, f"struct<results:array<struct<{_colons(PAPER)}>>>")["results"]).alias("r")).select("r.*")
    open_ = F.filter("instances", lambda x: F.coalesce((x["accessRight"]["label"] == "OPEN") | (x["accessRight"]["code"] == "c_abf2"), F.lit(False)))
    urls = F.flatten(F.transform(open_, lambda x: F.coalesce(x["urls"], F.array().cast("array<string>"))))
    pdf = F.filter(urls, lambda u: F.lower(u).endswith(".pdf"))
    doi = F.get(F.filter("pids", lambda p: p["scheme"] == "doi"), 0)["value"]
    people = F.transform(F.filter("authors", lambda a: a["fullName"].isNotNull()), lambda a: F.struct(a["fullName"].alias("fullName"), F.when(a["pid"]["id"]["scheme"] == "orcid", a["pid"]["id"]["value"]).alias("orcid")))
    topics = F.filter(F.transform("subjects", lambda s: F.struct(F.coalesce(s["subject"]["scheme"], F.lit("")).alias("scheme"), F.coalesce(s["subject"]["value"], F.lit("")).alias("value"))), lambda s: s["value"] != "")
    return r.where("id is not null and mainTitle is not null").select(
        "id", c("mainTitle").alias("title"), F.get("descriptions", F.lit(0)).alias("description"), people.alias("authors"), c("publicationDate").alias("publication_date"), doi.alias("doi"),
        F.get("source", F.lit(0))["name"].alias("journal"), "publisher", topics.alias("subjects"), F.when(F.size(pdf) > 0, pdf).otherwise(urls).alias("pdf_urls"), F.coalesce("bestAccessRight.code", F.lit("UNKNOWN")).alias("access_right"),
    )


def _colons(ddl: str) -> str:
    """'a string, b int' as 'a:string,b:int' for the fields of a struct."""
    return re.sub(r"(^|[,\n])\s*(\w+) (?=\w)", r"\1\2:", ddl).replace("\n", "").replace(", ", ",")


PATTERNS = {
    "rust": r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(fn|struct|enum|trait)\s+(\w+)",
    "typescript": r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(function|class|interface|type|enum)\s+(\w+)",
    "javascript": r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(function|class)\s+(\w+)",
    "c": r"(?m)^(?:static\s+|inline\s+)*(struct|enum|[A-Za-z_]\w*[\s*]+)\s*(\w+)\s*(?:\([^;{]*\)\s*)?\{",
}


def code_items(language: str, text: str) -> list[tuple[str, str, int, int]]:
    """(kind, name, first line, last line) of the definitions in a file."""
    if language == "python":
        try:
            tree = ast.parse(text)
        except SyntaxError:
            return []
        kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}
        return sorted(((kinds[type(x)], x.name, x.lineno, x.end_lineno or x.lineno) for x in ast.walk(tree) if type(x) in kinds), key=lambda x: x[2:])
    found = [(m[1].strip(), m[2], text.count("\n", 0, m.start(2)) + 1) for m in re.finditer(PATTERNS.get(language, r"(?!)()()"), text)]
    last = text.count("\n") + 1
    kinds = {"fn": "function", "function": "function"}
    ends = [line - 1 for _, _, line in found[1:]] + [last]
    return [(kinds.get(k, k if k in ("struct", "enum", "trait", "class", "interface", "type") else "function"), n, a, max(a, b)) for (k, n, a), b in zip(found, ends, strict=True)]


def language_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), ext)


def code(spark: SparkSession, path: str) -> DataFrame:
    """(id, file_path, language, kind, name, line_start, line_end, code) of all source files under a path;
    documents are one item each."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(c("_metadata.file_path").alias("file_path"), c("value").alias("text"))
    files = files.withColumn("language", language_of(c("file_path"))).where("language is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, text, lang in zip(batch["file_path"], batch["text"], batch["language"], strict=True):
                lines = text.split("\n")
                if lang in ("markdown", "rst"):
                    rows.append((p, lang, "doc", p.rsplit("/", 1)[-1], 1, len(lines), text))
                    continue
                rows += [(p, lang, kind, name, a, b, "\n".join(lines[a - 1 : b])) for kind, name, a, b in code_items(lang, text)]
            yield pd.DataFrame(rows, columns=["file_path", "language", "kind", "name", "line_start", "line_end", "code"])

    items = files.mapInPandas(run, "file_path string, language string, kind string, name string, line_start int, line_end int, code string")
    return items.select(F.concat(F.lit("code-"), F.hex(F.xxhash64("file_path", "kind", "name", "line_start"))).alias("id"), "*")


def refresh_code(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """Old items without those of changed or missing files (column file_path), with the new items of these."""
    files = changed.select(c("file_path").alias("__f"))
    kept = old.join(files, c("file_path") == c("__f"), "left_anti")
    return kept.unionByName(new.join(files, c("file_path") == c("__f"), "left_semi"))


def title_of(text: Column) -> Column:
    return first_line_title(text)
