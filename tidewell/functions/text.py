"""Column functions over texts and JSON: cutting, redacting, tokenising, classifying. Built-in expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, tags and prefixes that results depend on.
CORRECTIONS = (
    r"\bthat(?:'s| is) (?:wrong|incorrect)\b", r"\byou misunderstood\b", r"\btry again\b", r"\bredo\b",
    "不对", "你理解错了", "你理解有误", "重试", "重新来", "换一种", "改用",
)
REINFORCEMENTS = (
    r"\byes[,.]?\s+(?:exactly|perfect|that(?:'s| is) (?:right|correct|it))\b", r"\bperfect(?:[.!?]|$)", r"\bexactly\s+(?:right|correct)\b",
    r"\bthat(?:'s| is)\s+(?:exactly\s+)?(?:right|correct|what i (?:wanted|needed|meant))\b", r"\bkeep\s+(?:doing\s+)?that\b", r"\bjust\s+(?:like\s+)?(?:that|this)\b",
    r"\bthis is (?:great|helpful)\b(?:[.!?]|$)", r"\bthis is what i wanted\b(?:[.!?]|$)", r"对[，,]?\s*就是这样(?:[。！？!?.]|$)", r"完全正确(?:[。！？!?.]|$)",
    r"(?:对[，,]?\s*)?就是这个意思(?:[。！？!?.]|$)", r"正是我想要的(?:[。！？!?.]|$)", r"继续保持(?:[。！？!?.]|$)",
)
STATUS_PREFIXES = (("Task Succeeded. Result:", "completed"), ("Task polling timed out", "polling_timed_out"), ("Task timed out", "timed_out"), ("Task cancelled by user", "cancelled"), ("Task failed.", "failed"), ("Error", "failed"))
SUBAGENT_EVENTS = {"task_started": "subagent.start", "task_running": "subagent.step", "task_completed": "subagent.end", "task_failed": "subagent.end", "task_cancelled": "subagent.end", "task_timed_out": "subagent.end"}
INTERNAL_TAGS = ("uploaded_files", "slash_skill_activation", "system-reminder", "memory", "current_date")
BLOCKED_TAGS = ("system-reminder", "memory", "current_date", "think", "analysis", "subagent_system", "skill_system", "uploaded_files", "todo_list_system", "system", "instruction", "role", "important", "override", "ignore", "prompt")
INPUT_BEGIN, INPUT_END = "--- BEGIN USER INPUT ---", "--- END USER INPUT ---"
SAFETY_CODES = ("SAFETY", "BLOCKLIST", "PROHIBITED_CONTENT", "SPII", "RECITATION", "IMAGE_SAFETY", "IMAGE_PROHIBITED_CONTENT", "IMAGE_RECITATION")
# (flags, pattern, what is put), applied in this order. A header line of an authorization key keeps its bearer form.
REDACTIONS = (
    ("", r"(?<![\w.-])(/Users|/home)/([^/\s:]+)", "$1/<user>"),
    ("i", r"([A-Z]:\\Users\\)([^\\\s:]+)", "$1<user>"),
    ("", r"([a-zA-Z][\w+.-]*://)([^/?#\s@]+)@", "$1<redacted>@"),
    ("i", r"([?&][\w.-]*(?:api[_-]?key|token|secret|password|passwd|authorization|access[_-]?token|credential)[\w.-]*=)([^&\s#]+)", "$1<redacted>"),
    ("i", r"(--?[\w.-]*(?:api[_-]?key|token|secret|password|passwd|authorization|cookie|credential)[\w.-]*=)(\S+)", "$1<redacted>"),
    ("im", r"^([A-Z0-9_]*(?:API[_-]?KEY|TOKEN|SECRET|PASSWORD|PASSWD|AUTHORIZATION|COOKIE|CREDENTIAL)[A-Z0-9_]*\s*=\s*)(.+)$", "$1<redacted>"),
    ("im", r"^(?!\s*[\w.-]*authorization[\w.-]*\s*:\s*bearer )(\s*[\w.-]*(?:api[_-]?key|token|secret|password|passwd|authorization|cookie|credential|private[_-]?key)[\w.-]*\s*:\s*)(.+)$", "$1<redacted>"),
    ("i", r"(Bearer\s+)[A-Za-z0-9._~+/=-]+", "$1<redacted>"),
    ("", r"\bsk-[A-Za-z0-9_-]{8,}\b", "sk-<redacted>"),
)
OUTLINE_BOLD = r"^\*\*((?:ITEM|PART|SECTION|SCHEDULE|EXHIBIT|APPENDIX|ANNEX|CHAPTER)\b[A-Z0-9 .,\-]*)\*\*\s*$"
OUTLINE_SPLIT = r"^\*\*[\dA-Z][\d.]*\*\*\s+\*\*(?!\d[\d\s.,\-–—/:()%]*\*\*)[^*]+\*\*(?:\s+\*\*[^*]+\*\*){0,2}\s*$"
UPLOADS = r"(?i)<uploaded_files>[\s\S]*?</uploaded_files>\n*"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: str | Column) -> Column:
    """All Unicode white space taken off both ends."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def any_match(x: str | Column, patterns: tuple[str, ...]) -> Column:
    """Whether any of the patterns occurs, regardless of case; one alternation, so the text is searched once."""
    return F.coalesce(_c(x).rlike("(?iu)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def message_text(content: str | Column, sep: str = "") -> Column:
    """Text of a JSON message content: a string, a list of strings and {text} or {content} blocks, or such a map.

    A content that is no JSON is its own text."""
    c = _c(content)
    v = F.try_parse_json(c)
    of = lambda b: F.coalesce(
        F.when(F.schema_of_variant(b) == "STRING", F.try_variant_get(b, "$", "string")), F.try_variant_get(b, "$.text", "string"), F.try_variant_get(b, "$.content", "string"), F.lit("")
    )
    blocks = F.try_variant_get(v, "$", "array<variant>")
    listed = F.array_join(F.filter(F.transform(blocks, of), lambda s: (s != "") if sep else F.lit(True)), sep)
    return F.when(v.isNull(), c).when(blocks.isNotNull() & c.startswith("["), listed).when(c.startswith("{"), of(v)).otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), c))


def bound_text(text: str | Column, cap: int = 2000) -> Column:
    """Head of two thirds and tail of the rest around a mark, where the text is longer than the cap."""
    c, head = _c(text), cap * 2 // 3
    mark = "\n...\n"
    return F.when(F.length(c) <= cap, c).otherwise(F.concat(F.left(c, F.lit(head)), F.lit(mark), F.right(c, F.lit(max(0, cap - head - len(mark))))))


def line_start_before(c: Column, pos: Column) -> Column:
    """``pos``, or the start of the last line that begins in the second half of the text before it."""
    half = F.floor(pos / 2).cast("int")
    back = F.locate("\n", F.reverse(F.substring(c, half + 1, pos - half)))
    return F.when((pos > 0) & (pos < F.length(c)) & (back > 0), pos - back + 1).otherwise(pos)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _ends(c: Column, head: Column, tail: Column) -> Column:
    """struct(head, tail) of about the given lengths, both starting or ending at a line where one is near."""
    total = F.length(c)
    cut = lambda first, at, line: F.struct(F.left(c, first).alias("head"), F.substring(c, F.when(line > first, line).otherwise(at) + 1, total).alias("tail"))
    rest = lambda first: _let(F.greatest(first, total - tail), lambda at: _let(line_start_before(c, at), lambda line: cut(first, at, line)))
    return _let(line_start_before(c, F.least(head, total)), rest)


def output_limit(tool: Column, over: int, thresholds: dict[str, int] | None) -> Column:
    limit = F.lit(over)
    for name, n in (thresholds or {}).items():
        limit = F.when(tool == name, F.lit(n)).otherwise(limit)
    return limit


def budget_output(
    text: str | Column, tool: str | Column, path: str | Column | None = None, over: int = 12_000, head: int = 2_000, tail: int = 1_000,
    thresholds: dict[str, int] | None = None, exempt: tuple[str, ...] = ("read_file", "read_file_tool"), most: int = 30_000, most_head: int = 8_000, most_tail: int = 3_000,
) -> Column:
    """A tool's output within its budget. Over the tool's threshold and with a ``path`` where it is stored: head, a reference
    to the path, and tail. Otherwise, over ``most`` characters: head, a mark and tail, ``most`` together at the most."""
    c, t = _c(text), _c(tool)
    total, put = F.length(c), _c(path) if path is not None else F.lit(None).cast("string")
    limit = output_limit(t, over, thresholds)
    said = lambda left_out: F.format_string(
        "\n\n[Full %s output saved to %s (%d chars, ~%d tokens). Use read_file with start_line and end_line to access specific sections. %d chars omitted from this preview.]\n\n",
        t, put, total, F.floor(total / 4), left_out,
    )
    mark = lambda n: F.format_string("\n\n[... %d chars omitted from %s output. Persistent storage unavailable. Consider narrowing the query or using more specific parameters.]\n\n", n, t)
    around = lambda ends, between: _let(ends, lambda e: F.concat(e["head"], between(total - F.length(e["head"]) - F.length(e["tail"])), e["tail"]))
    preview = around(_ends(c, F.lit(head), F.lit(tail)), said)

    def bounded(room: Column) -> Column:
        own_head = F.least(F.lit(most_head), room)
        return F.when(room <= 0, F.left(c, F.lit(most))).otherwise(around(_ends(c, own_head, F.least(F.lit(most_tail), F.greatest(F.lit(0), room - own_head))), mark))

    short = _let(F.lit(most) - F.length(mark(total)), bounded)
    stored = (limit > 0) & (total > limit) & put.isNotNull()
    return F.when(t.isin(*exempt), c).when(stored, preview).when((total > most) & F.lit(most > 0), short).otherwise(c)


def redact_text(text: str | Column) -> Column:
    """Home folders, user info in addresses, secrets in addresses, options, settings and headers, and keys masked."""
    c = _c(text)
    for flags, pattern, put in REDACTIONS:
        c = F.regexp_replace(c, f"(?{flags}dU){pattern}", put)  # Unicode classes, and only line feeds end lines
    return c


def sanitize_input(text: str | Column) -> Column:
    """Blocked tags escaped, boundary lines inside the text neutralised, the whole put between boundary lines.

    Blank texts stay, and a text that already is between boundary lines gets no second pair."""
    c = _c(text)
    tag = r"(?iU)<\s*/?\s*(?:" + "|".join(BLOCKED_TAGS) + r")\b"
    # a tag reaches to the next closing bracket, so each part between those is escaped from its first blocked tag on
    parts, last = F.split(c, ">", -1), F.size(F.split(c, ">", -1)) - 1

    def part(x: Column, i: Column) -> Column:
        at = F.regexp_instr(x, F.lit(tag))
        shut = F.concat(F.left(x, at - 1), F.replace(F.substring(x, at, F.length(x)), F.lit("<"), F.lit("&lt;")), F.when(i < last, F.lit("&gt;")).otherwise(F.lit("")))
        return F.when(at > 0, shut).otherwise(F.concat(x, F.when(i < last, F.lit(">")).otherwise(F.lit(""))))

    escaped = F.when(c.rlike(tag), F.array_join(F.transform(parts, part), "")).otherwise(c)
    plain = lambda x: F.replace(F.replace(x, F.lit(INPUT_BEGIN), F.lit("[BEGIN USER INPUT]")), F.lit(INPUT_END), F.lit("[END USER INPUT]"))
    inner = F.substring(escaped, F.lit(len(INPUT_BEGIN) + 1), F.length(escaped) - len(INPUT_BEGIN) - len(INPUT_END))
    wrapped = escaped.startswith(INPUT_BEGIN) & escaped.endswith(INPUT_END)
    return F.when(strip(c) == "", c).when(wrapped, F.concat(F.lit(INPUT_BEGIN), plain(inner), F.lit(INPUT_END))).otherwise(F.concat(F.lit(INPUT_BEGIN + "\n"), plain(escaped), F.lit("\n" + INPUT_END)))


def split_reasoning(text: str | Column) -> Column:
    """struct(reasoning, content): bodies of think tags, also of one that is still open unless a backtick stands before it."""
    c = _c(text)
    bodies = F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"<think>([\s\S]*?)</think>"), F.lit(1)), strip), lambda b: b != "")
    rest = F.regexp_replace(c, r"<think>[\s\S]*?</think>", "")
    at = F.locate("<think>", rest)
    open_ = (at > 0) & (F.substring(rest, at - 1, F.lit(1)) != "`")
    tail = strip(F.substring(rest, at + 7, F.length(rest)))
    bodies = F.when(open_ & (tail != ""), F.concat(bodies, F.array(tail))).otherwise(bodies)
    kept = F.when(open_, F.left(rest, at - 1)).otherwise(rest)
    return F.struct(F.array_join(bodies, "\n\n").alias("reasoning"), strip(kept).alias("content"))


def strip_internal_markers(text: str | Column) -> Column:
    c = _c(text)
    for tag in INTERNAL_TAGS:
        c = F.regexp_replace(c, f"<{tag}>[\\s\\S]*?</{tag}>", "")
    return strip(c)


def strip_uploads(text: str | Column) -> Column:
    return strip(F.regexp_replace(_c(text), UPLOADS, ""))


def estimate_tokens(text: str | Column) -> Column:
    """Characters over 4, Han, kana and Hangul over 2, both floored."""
    c = F.coalesce(_c(text), F.lit(""))
    cjk = F.length(c) - F.length(F.regexp_replace(c, "[一-鿿぀-ヿ가-힣]", ""))
    return (F.floor((F.length(c) - cjk) / 4) + F.floor(cjk / 2)).cast("long")


def tokenize(text: str | Column) -> Column:
    """Distinct identifiers of two or more characters in lower case, and runs of Han with their 2- and 3-grams."""
    c = _c(text)
    words = F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z_][A-Za-z0-9_]+"), F.lit(0)), F.lower)
    runs = F.regexp_extract_all(c, F.lit("[㐀-䶿一-鿿]+"), F.lit(0))
    grams = lambda n: F.flatten(F.transform(F.filter(runs, lambda r: F.length(r) >= n), lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - n + 1), lambda i: F.substring(r, i, F.lit(n)))))
    return F.array_distinct(F.concat(words, runs, grams(2), grams(3)))


def task_status(text: str | Column) -> Column:
    """Status that a task result's first words state, the first listed prefix winning; null for other texts."""
    c, out = strip(text), F.lit(None).cast("string")
    for prefix, status in reversed(STATUS_PREFIXES):
        out = F.when(c.startswith(prefix), status).otherwise(out)
    return out


def subagent_event(event: str | Column) -> Column:
    """Event kind of a task chunk type; null for those that are dropped."""
    table = F.create_map(*[F.lit(x) for kv in SUBAGENT_EVENTS.items() for x in kv])
    return table[_c(event)]


def parse_choice(text: str | Column) -> Column:
    """Letter A to D that a text starts with or names after an answer label; null if none."""
    c = F.upper(strip(text))
    named = F.regexp_extract(c, r"(?U)ANSWER\s*(?:IS)?\s*[:：]?\s*\(?([A-D])\b", 1)
    return F.coalesce(F.nullif(F.regexp_extract(c, r"(?U)^\(?([A-D])\b", 1), F.lit("")), F.nullif(named, F.lit("")))


def parse_cpu(raw: str | Column) -> Column:
    """Millicores of ``250m`` or of a number of cores; null for anything else."""
    c = F.trim(_c(raw))
    n = F.regexp_extract(c, r"^(\d+(?:\.\d+)?)m?$", 1).try_cast("decimal(24,6)")
    return F.when(c.endswith("m"), n).otherwise(n * 1000).cast("long")


def parse_memory(raw: str | Column) -> Column:
    """Bytes of a number with a binary (Ki to Ti) or decimal (K to T) unit, or none; null for anything else."""
    c = F.trim(_c(raw))
    n = F.regexp_extract(c, r"^(\d+(?:\.\d+)?)(Ki|Mi|Gi|Ti|K|M|G|T)?$", 1).try_cast("decimal(24,6)")
    unit = F.regexp_extract(c, r"^(\d+(?:\.\d+)?)(Ki|Mi|Gi|Ti|K|M|G|T)?$", 2)
    scale = {"": 1} | {u + b: (1024 if b else 1000) ** (i + 1) for i, u in enumerate("KMGT") for b in ("", "i")}
    table = F.create_map(*[x for u, s in scale.items() for x in (F.lit(u), F.lit(s).cast("long"))])
    return (n * table[unit]).cast("long")


def summary_lines(text: str | Column, lines: int = 3, cap: int = 240) -> Column:
    kept = F.filter(F.transform(F.split(_c(text), "\n"), strip), lambda x: x != "")
    return F.left(F.array_join(F.slice(kept, 1, lines), " "), F.lit(cap))
