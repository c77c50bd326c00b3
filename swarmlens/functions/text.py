"""Text functions as column expressions; Python only where a state machine needs it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentence ends that chunks prefer, best first.
SENTENCE_ENDS = ["。", "！", "？", ".\n", "!\n", "?\n", "\n\n", ". ", "! ", "? "]


def normalized(text: str | Column) -> Column:
    """One kind of line end, at most one blank line, no white space around lines or the whole."""
    text = F.col(text) if isinstance(text, str) else text
    lines = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n{3,}", "\n\n")
    stripped = F.transform(F.split(lines, "\n"), lambda line: F.regexp_replace(line, r"(?U)^\s+|\s+$", ""))
    return F.regexp_replace(F.array_join(stripped, "\n"), r"(?U)^\s+|\s+$", "")


def stats(text: str) -> list[Column]:
    """Characters, lines and words."""
    t = F.col(text)
    return [
        F.length(t).alias("total_chars"),
        (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1).alias("total_lines"),
        F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")).alias("total_words"),
    ]


def chunk(text: str, size: int = 500, overlap: int = 50) -> list[str]:
    """Pieces of about ``size`` characters that end at a sentence where one ends in their last 70 %."""
    if not 0 <= overlap < 0.3 * size:
        raise ValueError("overlap must be under 0.3 of the size")
    if len(text) <= size:
        return [text] if text.strip() else []
    pieces, at = [], 0
    while True:
        stop = at + size
        if stop >= len(text):
            break
        for mark in SENTENCE_ENDS:
            found = text.rfind(mark, at, stop)
            if found > at + 0.3 * size:
                stop = found + len(mark)
                break
        pieces.append(text[at:stop])
        if stop >= len(text):
            at = len(text)
            break
        at = stop - overlap
    pieces.append(text[at:])
    return [p.strip() for p in pieces if p.strip()]


def chunks(docs: DataFrame, size: int = 500, overlap: int = 50, key: str = "doc_id") -> DataFrame:
    """(key, k, chunk) of every document, k from 0; Arrow batches, no shuffle."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, pieces = [], [], []
            for row, body in enumerate(batch.column(1).to_pylist()):
                found = chunk(body or "", size, overlap)
                rows += [row] * len(found)
                places += range(len(found))
                pieces += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(places, pa.int32()), pa.array(pieces, pa.string())], names=[key, "k", "chunk"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, k int, chunk string")


def keywords(query: Column) -> Column:
    """Lower-case words of two characters or more; a word that stands twice counts twice."""
    words = F.split(F.translate(F.lower(query), ",，", "  "), r"(?U)\s+")
    return F.filter(words, lambda w: F.length(w) > 1)


def _keyword_hits(low: Column, query: str | Column) -> Column:
    """10 for each keyword of the query in a lower-case text; a query known beforehand is split once, not for every row."""
    if isinstance(query, str):
        words = [w for w in query.lower().replace(",", " ").replace("\uff0c", " ").split() if len(w) > 1]
        hits = F.lit(0)
        for w in words:
            hits = hits + F.when(F.contains(low, F.lit(w)), 10).otherwise(0)
        return hits
    return 10 * F.size(F.filter(keywords(query), lambda w: F.contains(low, w)))


def match_score(text: Column, query: str | Column) -> Column:
    """100 if the text holds the whole query, else 10 for each keyword in it; empty texts 0."""
    low = F.lower(text)
    whole = F.lit(query.lower()) if isinstance(query, str) else F.lower(query)
    return F.when(F.coalesce(text, F.lit("")) == "", 0).when(F.contains(low, whole), 100).otherwise(_keyword_hits(low, query))


def relevance(text: Column, query: str | Column) -> Column:
    """100 for the whole query and 10 more for each keyword."""
    low = F.lower(text)
    whole = F.lit(query.lower()) if isinstance(query, str) else F.lower(query)
    return F.when(F.contains(low, whole), 100).otherwise(0) + _keyword_hits(low, query)


def username(name: Column) -> Column:
    """Lower-case letters, digits and underscores, and a three-digit number from the name's md5."""
    base = F.regexp_replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), r"[^\p{L}\p{N}_]", "")
    number = 100 + F.pmod(F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long"), F.lit(900).cast("long"))
    return F.concat(base, F.lit("_"), number.cast("string"))


def _quoted(x: Column) -> Column:
    return F.concat(F.lit('"'), x, F.lit('"'))


# what an episode says of an action: (with content, without)
_TOLD = {
    "CREATE_POST": ("posted: {content}", "posted"),
    "LIKE_POST": ("liked {author} post: {post}", "liked a post"),
    "DISLIKE_POST": ("disliked {author} post: {post}", "disliked a post"),
    "REPOST": ("reposted {author} post: {post}", "reposted a post"),
    "QUOTE_POST": ("quoted {author} post: {post}", "quoted a post"),
    "FOLLOW": ("followed {target}", "followed a user"),
    "CREATE_COMMENT": ("commented: {content}", "commented"),
    "LIKE_COMMENT": ("liked {author} comment: {comment}", "liked a comment"),
    "DISLIKE_COMMENT": ("disliked {author} comment: {comment}", "disliked a comment"),
    "SEARCH_POSTS": ("searched posts for {query}", "searched posts"),
    "SEARCH_USER": ("searched users for {query}", "searched users"),
    "MUTE": ("muted {target}", "muted a user"),
}


def episode(name: str | Column, action_type: Column, args: Column) -> Column:
    """``name: what the agent did``, in as much detail as the arguments (a map) give."""
    name = F.col(name) if isinstance(name, str) else name

    def arg(*names: str) -> Column:
        return F.coalesce(*(F.nullif(F.try_element_at(args, F.lit(n)), F.lit("")) for n in names))

    author = F.coalesce(F.concat(arg("post_author_name", "original_author_name", "comment_author_name"), F.lit("'s")), F.lit("a"))
    parts = {
        "content": _quoted(arg("content")),
        "post": _quoted(arg("post_content", "original_content")),
        "comment": _quoted(arg("comment_content")),
        "target": arg("target_user_name"),
        "query": _quoted(arg("query", "keyword", "username")),
        "author": author,
    }
    told = None
    for kind, (full, bare) in _TOLD.items():
        pieces = [F.lit(p) if k % 2 == 0 else parts[p] for k, p in enumerate(full.replace("}", "{").split("{"))]
        text = F.coalesce(F.concat(*pieces), F.lit(bare))  # concat with a missing part is null
        told = F.when(action_type == kind, text) if told is None else told.when(action_type == kind, text)
    comment = F.coalesce(F.concat(F.lit(", saying "), _quoted(arg("quote_content", "content"))), F.lit(""))
    told = told.otherwise(F.concat(F.lit("did "), action_type))
    return F.concat(name, F.lit(": "), told, F.when(action_type == "QUOTE_POST", comment).otherwise(""))


def fact_chain(source: Column, relation: Column, target: Column) -> Column:
    return F.concat(source, F.lit(" --["), relation, F.lit("]--> "), target)


def short_name(name: Column, id: Column) -> Column:
    """The name, or the first eight characters of the id."""
    return F.coalesce(F.nullif(name, F.lit("")), F.left(id, F.lit(8)))


def cut(text: Column, n: int, tail: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n - len(tail))), F.lit(tail))).otherwise(text)


def without_thinking(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def without_fences(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"(?i)^```(?:json)?\s*\n?", ""), r"\n?```\s*$", ""))


def pascal(name: Column) -> Column:
    return F.array_join(F.transform(F.split(name, "_"), lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substring(p, F.lit(2), F.length(p))))), "")


def key_quotes(text: Column, n: int = 3) -> Column:
    """The longest sentences of 20 to 150 characters that don't begin with punctuation, longest first."""
    sentences = F.transform(F.split(text, r"[。！？.!?\n]+"), lambda s: F.trim(s))
    good = F.filter(sentences, lambda s: F.length(s).between(20, 150) & ~s.rlike(r"^[\p{P}\s]"))
    ranked = F.array_sort(F.transform(good, lambda s, i: F.struct((-F.length(s)).alias("n"), i.alias("i"), s.alias("s"))))
    return F.slice(F.transform(ranked, lambda x: x["s"]), 1, n)


def interview_prompt(prompt: Column, prefix: str) -> Column:
    """The prompt with the prefix, once."""
    return F.when(F.startswith(prompt, F.lit(prefix)), prompt).otherwise(F.concat(F.lit(prefix), prompt))


def file_kind(name: Column) -> Column:
    """Class of a file by its extension."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.when(ext == "pdf", "pdf").when(ext.isin("md", "markdown"), "markdown").when(ext == "txt", "text").otherwise("other")


def allowed_file(name: Column, allowed: tuple[str, ...] = ("pdf", "md", "txt", "markdown")) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*allowed)


# Attribute names that a graph keeps for itself.
RESERVED = ("uuid", "name", "group_id", "name_embedding", "summary", "created_at")


def guarded_attribute(name: Column) -> Column:
    return F.when(F.lower(name).isin(*RESERVED), F.concat(F.lit("entity_"), name)).otherwise(name)
