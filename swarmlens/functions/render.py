"""Results as text for a reader, and back: each parser reads what its renderer wrote."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from swarmlens.functions.text import fact_chain, short_name


def edge_text(source: Column, name: Column, target: Column, fact: Column, valid: Column | None = None, invalid: Column | None = None, expired: Column | None = None) -> Column:
    """Relation and fact of an edge, with its span if ``valid`` is given."""
    parts = [F.lit("Relation: "), fact_chain(source, name, target), F.lit("\nFact: "), fact]
    if valid is not None:
        parts += [F.lit("\nValid: "), F.coalesce(valid, F.lit("unknown")), F.lit(" - "), F.coalesce(invalid, F.lit("now"))]
        parts.append(F.coalesce(F.concat(F.lit(" (expired: "), expired, F.lit(")")), F.lit("")))
    return F.concat(*parts)


def node_text(name: Column, entity_type: Column, summary: Column) -> Column:
    return F.concat(F.lit("Entity: "), name, F.lit(" (type: "), F.coalesce(entity_type, F.lit("unknown")), F.lit(")\nSummary: "), summary)


def facts_text(query: Column, facts: Column) -> Column:
    """A search result: the query, how many facts, and the facts numbered."""
    numbered = F.transform(facts, lambda f, i: F.concat((i + 1).cast("string"), F.lit(". "), f))
    head = F.concat(F.lit("Query: "), query, F.lit("\nFound: "), F.size(facts).cast("string"))
    return F.when(F.size(facts) > 0, F.concat(head, F.lit("\n\n### Facts\n"), F.array_join(numbered, "\n"))).otherwise(head)


def parsed_facts(text: Column) -> Column:
    """The facts of a rendered search result."""
    return F.transform(F.regexp_extract_all(F.concat(F.lit("\n"), text), F.lit(r"\n\d+\. ([^\n]*)"), 1), lambda x: x)


def entity_context(name: Column, attributes: Column, facts: Column, neighbours: Column) -> Column:
    """Attributes, facts and neighbours of an entity in one text; empty parts are left out."""

    def part(title: str, lines: Column) -> Column:
        listed = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n")
        return F.when(F.size(lines) > 0, F.concat(F.lit(f"### {title}\n"), listed))

    pairs = F.transform(F.map_entries(attributes), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.concat_ws("\n\n", F.concat(F.lit("## "), name), part("Attributes", pairs), part("Facts", facts), part("Neighbours", neighbours))


def config_context(requirement: str, entities: Column, document: Column, most: int = 50_000, reserve: int = 500) -> Column:
    """Requirement, entities and as much of the document as the limit leaves."""
    head = F.concat(F.lit(f"## Requirement\n{requirement}\n\n## Entities\n"), entities)
    left = F.greatest(F.lit(0), F.lit(most - reserve) - F.length(head))
    return F.concat(head, F.lit("\n\n## Document\n"), F.left(document, left))


def unwrapped(response: Column) -> Column:
    """The text inside a tool-call wrapper, if the response begins with one."""
    paths = ("content", "text", "body", "message", "reply")
    inner = F.coalesce(*(F.get_json_object(response, f"$.arguments.{p}") for p in paths), F.regexp_extract(response, r'"content"\s*:\s*"((?:[^"\\]|\\.)*)', 1))
    wrapped = F.startswith(F.ltrim(response), F.lit("{")) & F.contains(F.left(response, F.lit(80)), F.lit("tool_name"))
    return F.when(wrapped, F.coalesce(F.nullif(inner, F.lit("")), response)).otherwise(response)


def cleaned_response(response: Column) -> Column:
    """A response without Markdown headings, tool objects, emphasis, numbering of questions and rules."""
    text = F.regexp_replace(response, r"(?m)^#{1,6}\s+", "")
    text = F.regexp_replace(text, r'\{[^{}]*"tool_name"[^{}]*\}', "")
    text = F.regexp_replace(text, r"[*_`|>~-]{2,}", "")
    text = F.regexp_replace(text, r"(?m)^(?:Question|问题)\s*\d+[:：]\s*", "")
    return F.trim(F.regexp_replace(text, r"[【】]", ""))


def cleaned_quote(quote: Column) -> Column:
    """A quotation without marks and leading punctuation, at most 150 characters; null if it is of no use."""
    bare = F.regexp_replace(F.regexp_replace(quote, "[\u201c\u201d\"\u300c\u300d]", ""), r"^[，,；;：:、。！？\n\r\t ]+", "")
    bare = F.trim(bare)
    stop = F.locate("。", bare, 81)
    cut = F.when(F.length(bare) <= 150, bare).when(stop > 0, F.left(bare, stop)).otherwise(F.concat(F.left(bare, F.lit(147)), F.lit("...")))
    return F.when(~bare.rlike("问题[1-9]") & (F.length(cut) >= 10), cut)


def answers_of(text: Column) -> Column:
    """Answers to numbered questions; a text with one number at most is one answer."""
    parts = F.filter(F.transform(F.split(text, r"(?:^|\n)\s*(?:Question|问题)\s*\d+\s*[:：]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) > 1, parts).otherwise(F.array(F.trim(text)))


def answer_at(answers: Column, k: int) -> Column:
    """Answer k (from 0), else the first, else empty."""
    return F.coalesce(F.get(answers, F.lit(k)), F.get(answers, F.lit(0)), F.lit(""))


def final_answer(response: Column) -> Column:
    """The final answer of a response: tagged, after a marker, or from the first heading on."""
    ways = (r"(?s)<final_answer>(.*?)</final_answer>", r"(?is)final answer\s*[:：](.*)$", r"(?s)最终答案\s*[:：](.*)$", r"(?s)(?:^|\n)([#>].*)$")
    found = [F.nullif(F.trim(F.regexp_extract(response, w, 1)), F.lit("")) for w in ways]
    return F.coalesce(*found, F.trim(response))


def action_label(action_type: Column) -> Column:
    # Labels of actions.
    labels = {"CREATE_POST": "POST", "LIKE_POST": "LIKE", "DISLIKE_POST": "DISLIKE", "CREATE_COMMENT": "COMMENT", "LIKE_COMMENT": "LIKE", "DISLIKE_COMMENT": "DISLIKE", "QUOTE_POST": "QUOTE", "SEARCH_POSTS": "SEARCH", "SEARCH_USER": "SEARCH", "DO_NOTHING": "IDLE"}
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in labels.items() for x in p)), action_type), action_type)


def html(markdown: Column) -> Column:
    """Markdown of a report as HTML: headings, quotes, list items, rules, emphasis and code; the text itself is escaped."""
    text = F.replace(F.replace(F.replace(markdown, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    for level in (4, 3, 2, 1):
        text = F.regexp_replace(text, rf"(?m)^#{{{level}}} (.*)$", rf"<h{level}>$1</h{level}>")
    for pattern, tag in ((r"(?m)^&gt; (.*)$", "blockquote"), (r"(?m)^- (.*)$", "li"), (r"\*\*([^*\n]+)\*\*", "strong"), (r"\*([^*\n]+)\*", "em"), (r"`([^`\n]+)`", "code")):
        text = F.regexp_replace(text, pattern, f"<{tag}>$1</{tag}>")
    text = F.regexp_replace(text, r"(?m)^---$", "<hr>")
    return F.concat(F.lit("<p>"), F.regexp_replace(text, r"\n{2,}", "</p><p>"), F.lit("</p>"))


def type_source(name: Column, description: Column, attributes: Column) -> Column:
    """An entity type as the source of a class: its attributes are optional texts."""
    fields = F.array_join(F.transform(attributes, lambda a: F.concat(F.lit("    "), a, F.lit(": str | None = None"))), "\n")
    body = F.when(F.size(attributes) > 0, F.concat(F.lit("\n"), fields)).otherwise("")
    return F.concat(F.lit("class "), name, F.lit(':\n    """'), description, F.lit('"""'), body)


def short_id(id: Column) -> Column:
    return F.upper(F.left(id, F.lit(6)))


def short_file(name: Column, most: int = 20) -> Column:
    """A file name cut in front of its extension."""
    ext = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    base = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    return F.when(F.length(name) <= most, name).otherwise(F.concat(F.left(base, F.lit(most) - F.length(ext) - 3), F.lit("..."), ext))


# Reports of composite searches: rendered from small collected results, on the driver.


def insight_text(query: str, facts: list[str], entities: list[tuple[str, str]], chains: list[str]) -> str:
    out = ["## Insight", f"Question: {query}", "", "### Figures", f"- facts: {len(facts)}", f"- entities: {len(entities)}", f"- chains: {len(chains)}"]
    if facts:
        out += ["", "### Key facts", *(f'{k}. "{f}"' for k, f in enumerate(facts, 1))]
    if entities:
        out += ["", "### Entities", *(f"- **{n}** ({t})" for n, t in entities)]
    if chains:
        out += ["", "### Chains", *(f"- {c}" for c in chains)]
    return "\n".join(out)


def _section(text: str, title: str) -> list[str]:
    found = re.search(rf"^### {title}\n((?:.+\n?)*)", text, re.M)
    return found[1].strip().split("\n") if found else []


def parsed_insight(text: str) -> dict:
    """What `insight_text` was given."""
    entities = [re.match(r"- \*\*(.*)\*\* \((.*)\)$", x) for x in _section(text, "Entities")]
    return {
        "query": re.search(r"^Question: (.*)$", text, re.M)[1],
        "facts": [re.match(r'\d+\. "(.*)"$', x)[1] for x in _section(text, "Key facts")],
        "entities": [(m[1], m[2]) for m in entities],
        "chains": [x[2:] for x in _section(text, "Chains")],
    }


def panorama_text(query: str, active: list[str], historical: list[str], counts: tuple[int, int]) -> str:
    out = ["## Panorama", f"Query: {query}", "", "### Figures", f"- active: {counts[0]}", f"- historical: {counts[1]}"]
    for title, facts in (("Active facts", active), ("Historical facts", historical)):
        if facts:
            out += ["", f"### {title}", *(f'{k}. "{f}"' for k, f in enumerate(facts, 1))]
    return "\n".join(out)


def parsed_panorama(text: str) -> dict:
    facts = lambda title: [re.match(r'\d+\. "(.*)"$', x)[1] for x in _section(text, title)]
    count = lambda name: int(re.search(rf"^- {name}: (\d+)$", text, re.M)[1])
    return {"query": re.search(r"^Query: (.*)$", text, re.M)[1], "active": facts("Active facts"), "historical": facts("Historical facts"), "counts": (count("active"), count("historical"))}


def interview_text(agent: str, role: str, bio: str, question: str, answer: str, quotes: list[str]) -> str:
    out = f"**{agent}** ({role})\n_Bio: {bio}_\n\n**Q:** {question}\n\n**A:** {answer}\n"
    return out + ("\n**Key quotes:**\n" + "".join(f'> "{q}"\n' for q in quotes) if quotes else "")


def parsed_interview(text: str) -> dict:
    head = re.match(r"\*\*(.*?)\*\* \((.*?)\)\n_Bio: (.*?)_\n\n\*\*Q:\*\* (.*?)\n\n\*\*A:\*\* (.*?)(?=\n\n\*\*Key quotes:|\n?\Z)", text, re.S)
    return dict(zip(("agent", "role", "bio", "question", "answer"), head.groups())) | {"quotes": re.findall(r'^> "(.*)"$', text, re.M)}


def named_chain(source: Column, source_id: Column, relation: Column, target: Column, target_id: Column) -> Column:
    return fact_chain(short_name(source, source_id), relation, short_name(target, target_id))
