"""Text functions as native expressions, and operators over texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col

# Words that keywords of titles leave out.
KEYWORD_STOP = (
    "the", "a", "of", "in", "and", "for", "with", "on", "to", "from", "by", "is", "are", "an", "as", "at", "its", "or", "that", "this", "be", "was",
    "were", "been", "study", "studies", "research", "analysis", "review", "paper", "using", "based", "between", "during", "through", "within",
    "their", "these", "those", "which", "what", "how", "effects", "effect", "role", "new", "novel", "model", "models", "approach", "methods", "method",
    "results", "data", "case", "cases", "evidence", "findings", "implications",
)
# Words that common keywords leave out.
COMMON_STOP = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are", "were", "be",
    "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "shall", "can",
    "this", "that", "these", "those", "it", "its", "i", "you", "we", "they", "my", "your", "our", "their", "what", "which", "who", "whom", "how",
)
# Terms that make a category name meaningless.
GENERIC = (
    "empty", "cluster", "misc", "other", "general", "various", "uncategorized", "miscellaneous", "group", "collection",
    "related", "topics", "items", "content", "stuff", "things", "mixed", "assorted", "combined", "merged", "grouped", "sorted",
)
# Words that a full-text query leaves out.
QUERY_STOP = ("the", "a", "an", "in", "on", "at", "to", "for", "of", "is", "it", "and", "or", "with", "from", "by", "this", "that", "as", "be")
# Patterns of messages.
SKIPPED_MESSAGES = ("keychange", "verified-change", "group-v2-change", "profile-change", "timer-notification", "change-number-notification", "contact-removed-notification")
ACKNOWLEDGES = r"(?i)^(ok|okay|k|yes|yeah|yep|yup|no|nah|nope|sure|agreed|sounds good|perfect|nice|lol|lmao|haha|thanks|thx|ty|cool|bet|word|right|true|fair|same|exactly|indeed|correct|ack|roger|noted|got it|makes sense|will do)$"
AGREES = r"(?i)^(agreed|let'?s do (it|that|this)|sounds good|sounds right|let'?s go with|perfect|i'?m (in|down|on board)|ship it|lgtm|approved|go for it|works for me|makes sense to me|i agree|deal|done|settled|confirmed|yes,? let'?s|good plan|love it)"
PROPOSES = r"(?i)(should we|how about|what if|i (think|suggest|propose|recommend)|we could|let'?s|option [a-z0-9]|plan:|proposal:|idea:)"
URL = r"(?:https?://|irc://|ftp://)[^\s<>\"'\)\]\}]+|www\.[^\s<>\"'\)\]\}]+|[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?\.(?:com|org|net|io|ai|dev|app|co|ee|fi|se|no|dk|lt|lv|de|uk|eu|me|info|tv|tech|xyz|site|gg|is|to)/[^\s<>\"'\)\]\}]*"
EMOJI = r"^[0-9#*\u00A9\u00AE\u200D\u203C\u2049\u20E3\u2122\u2139\u2194-\u21AA\u231A-\u23FF\u24C2\u25AA-\u27BF\u2934-\u2935\u2B05-\u2B55\u3030\u303D\u3297\u3299\uFE0F\x{1F000}-\x{1FAFF}\x{E0020}-\x{E007F}\s]{0,8}$"
TITLE_LENGTH, NODE_BYTES = 80, 15


def title_words(titles: DataFrame, column: str = "title") -> DataFrame:
    """(word, n) of cleaned title words: letters and digits, three bytes at least, no stop word, no number."""
    word = F.explode(F.split(F.trim(F.lower(column)), r"\s+"))
    words = titles.select(word.alias("w")).select(F.regexp_replace("w", r"[^\p{L}\p{N}]", "").alias("word"))
    words = words.where((F.octet_length("word") >= 3) & ~c("word").isin(*KEYWORD_STOP) & ~c("word").rlike(r"^\p{N}+$"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def top_keywords(titles: DataFrame, top: int = 3, column: str = "title") -> DataFrame:
    """One row: the most frequent title words, capitalised, or 'Mixed Topics'."""
    best = title_words(titles, column).orderBy(F.desc("n"), "word").limit(top)
    name = F.concat(F.upper(F.substring("word", 1, 1)), F.expr("substring(word, 2)"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-c("n")).alias("k"), c("word"), name.alias("name")))), lambda x: x["name"]), ", ")
    return best.agg(F.when(F.count("*") == 0, "Mixed Topics").otherwise(listed).alias("keywords"))


def common_words(texts: DataFrame, column: str = "title", share: float = 0.5) -> DataFrame:
    """(word, n): words in more than half of the texts."""
    words = F.array_distinct(F.split(F.lower(column), r"[^\p{L}\p{N}]+"))
    n = texts.select(F.explode(words).alias("word")).where((F.octet_length("word") > 2) & ~c("word").isin(*COMMON_STOP)).groupBy("word").agg(F.count("*").alias("n"))
    total = texts.agg(F.floor(F.count("*") * share).alias("half"))
    return n.join(F.broadcast(total), c("n") > c("half")).select("word", "n")


def is_generic_name(name: Column) -> Column:
    words = F.filter(F.split(F.trim(F.lower(name)), r"\s+"), lambda w: F.length(w) > 0)
    generic = F.size(F.filter(words, lambda w: F.exists(F.array(*map(F.lit, GENERIC)), lambda g: F.contains(w, g))))
    return (generic > 0) & (generic >= F.floor((F.size(words) + 1) / 2))


def capitalised(texts: DataFrame, least: int = 3, column: str = "title") -> DataFrame:
    """(word, n, ids): capitalised words of several texts, with the texts."""
    words = F.array_distinct(F.regexp_extract_all(column, F.lit(r"(\p{Lu}[\p{L}\p{N}]{2,})"), 1))
    out = texts.select("id", F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))
    return out.where(c("n") >= least)


def ascii_share(texts: DataFrame, column: str = "title") -> DataFrame:
    """One row: whether over nine tenths of all characters are ASCII."""
    plain = F.length(F.regexp_replace(column, r"[^\x00-\x7F]", ""))
    return texts.agg((F.try_divide(F.sum(plain), F.sum(F.length(column))) > 0.9).alias("english"))


def fts_query(text: Column) -> Column:
    """The words of a text worth searching, joined by OR."""
    trimmed = F.transform(F.split(F.trim(text), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", ""))
    kept = F.filter(trimmed, lambda w: (F.octet_length(w) >= 3) & ~F.lower(w).isin(*QUERY_STOP))
    return F.array_join(kept, " OR ")


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 0)


def bm25(docs: DataFrame, terms: list[str], text: Column, every: bool = False, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of the documents with any of the terms, or with all.

    Only the query's terms are kept of each document, so a document is one row with a
    count for each term."""

    def count(term: str) -> Column:
        return F.size(F.filter("words", lambda w: w == term))

    counts = [count(t).alias(f"t{i}") for i, t in enumerate(terms)]
    rows = docs.select("id", tokens(text).alias("words")).select("id", F.size("words").alias("n"), *counts)  # tokens are made once
    total = rows.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *(F.count_if(c(f"t{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    rows = rows.join(F.broadcast(total), F.lit(True))
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log((c("docs") - c(f"df{i}") + 0.5) / (c(f"df{i}") + 0.5) + 1)
        score = score + idf * c(f"t{i}") * (k1 + 1) / (c(f"t{i}") + k1 * (1 - b + b * c("n") / c("mean")))
    has = [c(f"t{i}") > 0 for i in range(len(terms))]
    keep = has[0]
    for h in has[1:]:
        keep = keep & h if every else keep | h
    return rows.where(keep).select("id", F.round(score, 6).alias("score"))


def resolve(nodes: DataFrame, ref: str) -> DataFrame:
    """(id, how): the node that a reference means: by id, by the only id prefix, or by the only title that holds it."""
    found = nodes.where(c("id") == ref).select("id", F.lit("id").alias("how"), F.lit(0).alias("k"))
    if len(ref) >= 6:
        found = found.unionByName(nodes.where(c("id").startswith(ref) & (c("id") != ref)).select("id", F.lit("prefix").alias("how"), F.lit(1).alias("k")))
    found = found.unionByName(nodes.where(c("title").ilike(f"%{ref}%")).select("id", F.lit("title").alias("how"), F.lit(2).alias("k")))
    w = Window.partitionBy()
    best = found.withColumn("best", F.min("k").over(w)).where("k = best").withColumn("n", F.count("*").over(w))
    return best.select("id", F.when(c("n") > 1, "ambiguous").otherwise(c("how")).alias("how")).orderBy("id").limit(10)


def strip_html(html: Column) -> Column:
    text = F.regexp_replace(html, r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _digits_only(text: Column) -> Column:
    return text.rlike(r"^[0-9\s.\-]*$")


def is_garbage(title: Column, abstract: Column) -> Column:
    t, a = F.trim(title), F.trim(abstract)
    bad = ((a != "") & (F.octet_length(a) < 50)) | _digits_only(a)
    return (F.octet_length(t) < 5) | _digits_only(t) | F.coalesce(bad, F.lit(False))


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def content_hash(title: Column, abstract: Column) -> Column:
    return F.substring(F.sha2(F.concat(_squeezed(title), F.lit("|"), F.coalesce(_squeezed(abstract), F.lit(""))), 256), 1, 32)


def first_line_title(text: Column, most: int = 60) -> Column:
    line = F.trim(F.regexp_extract(F.trim(text), r"^([^\n]*)", 1))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 3), F.lit("..."))).otherwise(line)


def sentence_title(text: Column) -> Column:
    """The first sentence if it ends within the limit, else the text cut at a word."""
    t = F.trim(text)
    sentence = F.regexp_extract(F.substring(t, 1, TITLE_LENGTH), r"(?s)^(.[^.!?]*[.!?])", 1)
    cut = F.substring(t, 1, TITLE_LENGTH)
    words = F.regexp_extract(cut, r"(?s)^(.*) ", 1)
    long = F.when(F.octet_length(words) > F.floor(F.octet_length(cut) / 2), F.concat(words, F.lit("..."))).otherwise(F.concat(cut, F.lit("...")))
    return F.when(F.length(t) == 0, "Empty message").when(F.length(sentence) > 0, sentence).when(F.length(t) <= TITLE_LENGTH, t).otherwise(long)


def normalise_url(url: Column) -> Column:
    full = F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(full, r"[.,)\]]+$", ""), r"#.*$", ""), "/$", "")


def url_id(url: Column, length: int = 32) -> Column:
    return F.substring(F.sha2(url, 256), 1, length)


def urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({URL})"), 1)


def domain(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)


def message_tier(kind: Column, body: Column, quoted: Column) -> Column:
    """skip, metadata (of the quoted message) or full."""
    b = F.trim(body)
    emoji = b.rlike(EMOJI)
    url = b.rlike(URL)
    one_word = ~F.contains(b, F.lit(" ")) & (F.octet_length(b) < 6)
    out = F.when(F.coalesce(kind.isin(*SKIPPED_MESSAGES), F.lit(False)) | b.isNull() | (b == ""), "skip")
    out = out.when(~quoted & (F.octet_length(b) <= 8) & emoji, "skip").when(~quoted & ~url & one_word, "skip")
    out = out.when(quoted & (F.octet_length(b) < NODE_BYTES) & b.rlike(ACKNOWLEDGES), "metadata").when(quoted & emoji, "metadata")
    return out.when(url | (F.octet_length(b) >= NODE_BYTES), "full").otherwise("skip")


def arxiv_id(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?i)(\d{4}\.\d{4,5}|[a-z-]+(?:\.[a-z]{2})?/\d{7})", 1), F.lit(""))


def pmc_id(text: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(text, r"(?i)(PMC\d+)", 1)), F.lit(""))


def duration_ms(text: Column) -> Column:
    """30m, 2h, 7d, 1w; null otherwise."""
    n = F.regexp_extract(text, r"^(\d+)[mhdw]$", 1).try_cast("long")
    unit = F.regexp_extract(text, r"^\d+([mhdw])$", 1)
    return n * F.when(unit == "m", 60_000).when(unit == "h", 3_600_000).when(unit == "d", 86_400_000).when(unit == "w", 604_800_000)


def jaccard(a: Column, b: Column) -> Column:
    """Of the words of two names, without punctuation around them; 1 if both have none."""
    bag = lambda x: F.filter(F.array_distinct(F.transform(F.split(F.trim(F.lower(x)), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))), lambda w: F.length(w) > 0)
    both, every = F.size(F.array_intersect(bag(a), bag(b))), F.size(F.array_union(bag(a), bag(b)))
    return F.when(every == 0, 1.0).otherwise(F.round(both / every, 6))


def json_reply(text: Column, schema: str) -> Column:
    """The object in a model's reply: fences gone, trailing commas repaired; null if there is none."""
    body = F.regexp_extract(F.regexp_replace(text, r"```(?:json)?", ""), r"(?s)(\{.*\}|\[.*\])", 1)
    return F.from_json(F.regexp_replace(body, r",\s*([}\]])", "$1"), schema)


def called_names(code: Column) -> Column:
    """Identifiers that a parenthesis follows, each once."""
    return F.array_distinct(F.regexp_extract_all(code, F.lit(r"\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), 1))


def call_edges(items: DataFrame) -> DataFrame:
    """(caller, callee) among code items (id, name, code); of a name defined twice the last id counts; no self calls."""
    defined = items.where("name is not null").groupBy("name").agg(F.max("id").alias("callee"))
    calls = items.select(c("id").alias("caller"), F.explode(called_names(c("code"))).alias("name"))
    return calls.join(defined, "name").where("caller != callee").select("caller", "callee").distinct()


def document_format(data: Column) -> Column:
    head = F.hex(F.substring(data, 1, 8))
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), "zip").when(head.startswith("D0CF11E0A1B11AE1"), "doc").otherwise("unknown")


def is_public_url(url: Column) -> Column:
    host = domain(url)
    return F.lower(url).rlike("^https?://") & F.contains(host, F.lit(".")) & ~host.isin("localhost", "127.0.0.1")
