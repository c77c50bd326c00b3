"""JSON repair and line state machines, as pandas UDFs."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def close_json(text: str) -> str:
    """A cut-off JSON text with its string, brackets and braces closed."""
    text = text.strip()
    inside, escaped, open_marks = False, False, []
    for c in text:
        if inside:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c in "[{":
            open_marks.append("]" if c == "[" else "}")
        elif c in "]}" and open_marks:
            open_marks.pop()
    if inside:
        text = (text[:-1] if escaped else text) + '"'
    return re.sub(r",\s*$", "", text) + "".join(reversed(open_marks))


def repaired(text: str | None) -> str | None:
    """The JSON object in ``text``, mended if that is possible, in one line; else null."""
    if not text:
        return None
    start = text.find("{")
    if start < 0:
        return None
    end = text.rfind("}")
    tries = [text[start : end + 1]] if end > start else []
    for body in [*tries, close_json(text[start:])]:
        for candidate in (body, re.sub(r"[\x00-\x1f]+", " ", body)):
            try:
                return json.dumps(json.loads(candidate), ensure_ascii=False, sort_keys=True)
            except ValueError:
                continue
    return None


def salvaged_profile(text: str | None, name: str, kind: str) -> dict:
    """Bio and persona of a profile, from whatever can be read of it; ``_fixed`` tells that it was mended."""
    found = repaired(text)
    if found is not None:
        values = json.loads(found)
        if values.get("bio") or values.get("persona"):
            return values
    values = {"_fixed": True}
    for key, default in (("bio", f"{name}, {kind}"), ("persona", f"{name} is a {kind}.")):
        hit = re.search(rf'"{key}"\s*:\s*"((?:[^"\\]|\\.)*)', text or "")
        values[key] = hit[1] if hit and hit[1] else default
    return values


def clean_section(content: str | None, title: str | None) -> str:
    """A section's body: without its own title, headings in bold, no blank lines or rules around it."""
    if not content:
        return ""
    lines = content.strip().split("\n")
    out = []
    for k, line in enumerate(lines):
        heading = re.match(r"^#{1,6}\s+(.*)$", line.strip())
        if heading:
            words = heading[1].strip()
            if k < 5 and title and words.replace(" ", "") == title.strip().replace(" ", ""):
                continue
            out += [f"**{words}**", ""]
        else:
            out.append(line)
    while out and out[0].strip() in ("", "---", "***", "___"):
        out.pop(0)
    while out and out[-1].strip() in ("", "---", "***", "___"):
        out.pop()
    return "\n".join(out)


def post_processed(report: str | None) -> str:
    """A report without repeated headings nearby, rules right after headings, and more than two blank lines."""
    out: list[str] = []
    for line in (report or "").split("\n"):
        text = line.strip()
        if text.startswith("#"):
            if any(text.lstrip("# ") == x.strip().lstrip("# ") for x in out[-5:] if x.strip().startswith("#")):
                continue
        if text == "---" and next((x for x in reversed(out) if x.strip()), "").startswith("#"):
            continue
        if not text and len(out) >= 2 and not out[-1].strip() and not out[-2].strip():
            continue
        out.append(line)
    return "\n".join(out).strip()


def _column(function):
    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: function(None if pd.isna(t) else t))

    return run


def repaired_json(text: Column) -> Column:
    return _column(repaired)(text)


def processed_report(text: Column) -> Column:
    return _column(post_processed)(text)


def cleaned_section(text: Column, title: Column) -> Column:
    @F.pandas_udf("string")
    def run(content: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([clean_section(c, t) for c, t in zip(content, name)], dtype=object)

    return run(text, title)


# The tools a report writer may call.
TOOLS = ("insight_forge", "panorama_search", "quick_search", "interview_agents")


def tool_calls(response: str) -> list[dict]:
    """Calls in a response: every tagged block, else the whole text, else an object at its end; unknown tools are left out."""
    bodies = re.findall(r"<tool_call>\s*(\{.*?\})\s*</tool_call>", response, re.S)
    if not bodies:
        text = response.strip()
        bodies = [text] if text.startswith("{") else re.findall(r"(\{\"(?:name|tool)\".*\})\s*$", text, re.S)
    found = []
    for body in bodies:
        try:
            call = json.loads(body)
        except ValueError:
            continue
        name = call.get("name", call.get("tool"))
        if name in TOOLS:
            found.append({"name": name, "parameters": call.get("parameters", call.get("params", {}))})
    return found
