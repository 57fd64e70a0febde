"""Stack traces: detection, frames, errors, root causes. Everything is batched over a table (trace_id, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import save

#: Frame patterns by language, as (expression, group of function, class, file, line); 0: absent.
_FRAME = {
    "python": r'^\s*File "([^"]+)", line (\d+)(?:, in (\S+))?',
    "cpp": r"^\s*#(\d+)\s+(?:0x[0-9a-fA-F]+ in )?(?:([A-Za-z_][A-Za-z0-9_:]*)::)?(~?[A-Za-z_][A-Za-z0-9_]*)\s*\([^)]*\)\s+at\s+(\S+?):(\d+)",
    "java": r"^\s*at\s+(?:([A-Za-z0-9_.@-]+)/)?([A-Za-z_$][A-Za-z0-9_.$]*)\.([A-Za-z_$<][A-Za-z0-9_$>]*)\(([^():]+)(?::(\d+))?\)",
    "rust": r"^\s*(\d+):\s+(?:0x[0-9a-f]+ - )?(?:(\S+)::)?([A-Za-z_][A-Za-z0-9_<>{}]*)(?:\s+at\s+(\S+?):(\d+)(?::(\d+))?)?\s*$",
}
#: Error category -> words that tell it, in order of precedence (fixed values).
CATEGORIES = {
    "null_pointer": ["NullPointerException", "NullReferenceException", "NoneType", "null pointer", "None has no attribute", "undefined is not a function"],
    "out_of_bounds": ["IndexOutOfBoundsException", "IndexError", "out of range", "out of bounds", "array index", "slice index", "bounds check"],
    "type_error": ["TypeError", "ClassCastException", "type mismatch", "cannot convert", "incompatible type", "no matching function"],
    "value_error": ["ValueError", "IllegalArgumentException", "invalid argument", "invalid value", "invalid literal", "format error"],
    "key_error": ["KeyError", "NoSuchElementException", "key not found", "missing key", "map key", "hash key"],
    "attribute_error": ["AttributeError", "MissingPropertyException", "has no attribute", "property not found", "member not found"],
    "file_error": ["FileNotFoundError", "IOException", "file not found", "cannot open file", "access denied", "permission denied"],
    "memory_error": ["MemoryError", "OutOfMemoryError", "out of memory", "memory allocation", "heap space", "stack overflow"],
    "concurrency": ["ConcurrentModificationException", "Deadlock", "RaceCondition", "thread", "lock", "synchronization", "mutex"],
    "panic": ["panic", "unreachable", "assertion failed", "unwrap failed"],
}
#: Error category -> severity (fixed values); medium for any other.
SEVERITY = {
    "null_pointer": "high", "out_of_bounds": "high", "memory_error": "critical", "concurrency": "critical", "panic": "critical",
    "file_error": "medium", "type_error": "medium", "value_error": "medium", "key_error": "low", "attribute_error": "low",
}
#: Category -> (likely cause, suggested fix), our own wording.
ADVICE = {
    "null_pointer": ("A value that may be missing was used without a check.", "Check for the missing value before use."),
    "out_of_bounds": ("An index lies outside its collection.", "Compare the index with the length first."),
    "type_error": ("A value of one type was used as another.", "Convert or check the value's type."),
    "value_error": ("A value has the right type but no valid content.", "Check values where they come in."),
    "key_error": ("A key was looked up that isn't there.", "Test for the key, or use a default."),
    "attribute_error": ("A member was used that the object doesn't have.", "Check the object's type and the member's name."),
    "file_error": ("A file could not be read or written.", "Check the path and the permissions."),
    "memory_error": ("Memory ran out.", "Lower what is held at once, or work in pieces."),
    "concurrency": ("Threads met in an order that was not foreseen.", "Guard the shared state."),
    "panic": ("The program gave up on a state that it held for impossible.", "Handle the error where it arises."),
    "unknown": ("The cause could not be told from the message.", "Look at the innermost frame."),
}


def detect_language(text: Column) -> Column:
    """The first of python, cpp, java, rust whose frames the text has; else python."""
    has = lambda p: text.rlike(f"(?m){p}")
    return F.when(has(r'^\s*File "[^"]+", line \d+') | text.contains("Traceback (most recent call last)"), "python").when(has(r"^\s*#\d+\s.* at \S+\.(?:c|cc|cpp|cxx|h|hpp):\d+"), "cpp").when(has(r"^\s*at [A-Za-z0-9_.$/@<>-]+\([^)]*\)"), "java").when(text.contains("panicked at") | has(r"^\s*\d+:\s+\S+::\S+"), "rust").otherwise("python")


def frames(traces: DataFrame) -> DataFrame:
    """Frames of traces (trace_id, text), numbered from 0 in the text's order; a Rust panic's place is the first of its frames."""
    joined = F.regexp_replace("text", r"(?m)(^\s*\d+:\s+\S+)\n\s+(at )", "$1 $2")
    panic = F.regexp_replace(joined, r"(?m)^.*panicked at (?:'[^'\n]*', )?(\S+?):(\d+)(?::\d+)?:?\s*$", "  0: panic at $1:$2")
    lined = traces.withColumn("language", detect_language(F.col("text"))).withColumn("lines", F.split(F.when(F.col("language") == "rust", panic).otherwise(joined), "\n"))
    lined = lined.select("trace_id", "language", F.posexplode("lines").alias("at", "raw_line"))
    g = lambda lang, i: F.nullif(F.regexp_extract("raw_line", _FRAME[lang], i), F.lit(""))
    is_ = lambda lang: F.col("language") == lang
    pick = lambda py, cpp, java, rust: F.when(is_("python"), py).when(is_("cpp"), cpp).when(is_("java"), java).when(is_("rust"), rust)
    none = F.lit(None).cast("string")
    found = None
    for lang, p in _FRAME.items():
        hit = is_(lang) & F.col("raw_line").rlike(p)
        found = hit if found is None else found | hit
    py_name = g("python", 3)
    dotted = lambda c: F.when(c.contains("."), F.element_at(F.split(c, r"\."), -1)).otherwise(c)
    owner = lambda c: F.when(c.contains("."), F.regexp_replace(c, r"\.[^.]*$", ""))
    java_class = g("java", 2)
    out = lined.filter(found)
    out = out.select(
        "trace_id", "at", "language", F.trim("raw_line").alias("raw_line"),
        pick(dotted(py_name), g("cpp", 3), g("java", 3), g("rust", 3)).alias("function_name"),
        pick(owner(py_name), g("cpp", 2), java_class, g("rust", 2)).alias("class_name"),
        pick(g("python", 1), g("cpp", 4), g("java", 4), g("rust", 4)).alias("file_path"),
        pick(g("python", 2), g("cpp", 5), g("java", 5), g("rust", 5)).cast("int").alias("line_number"),
        pick(none, none, g("java", 1), none).alias("module"),
        (F.col("raw_line").contains("Native Method") & is_("java")).alias("is_native"),
        F.col("raw_line").rlike(r"asyncio|async |coroutine").alias("is_async"),
    )
    n = F.row_number().over(_by_trace()) - 1
    return out.withColumn("frame_index", n).drop("at")


def _by_trace():
    return Window.partitionBy("trace_id").orderBy("at")


def errors(traces: DataFrame) -> DataFrame:
    """(trace_id, language, error_type, message): the error's line by the language's habit; UnknownError if there is none."""
    t = traces.select("trace_id", "text", detect_language(F.col("text")).alias("language"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^(?:Caused by: )?[A-Za-z_][A-Za-z0-9_.:]*(?:Error|Exception|Interrupt|Exit|Warning)\b|^std::"))
    line = F.when(F.col("language") == "python", F.get(F.reverse(lines), F.lit(0))).otherwise(F.get(lines, F.lit(0)))
    panic = F.regexp_extract("text", r"panicked at '?([^'\n]*)", 1)
    line = F.regexp_replace(line, "^Caused by: ", "")
    kind = F.nullif(F.regexp_extract(line, r"^([A-Za-z_][A-Za-z0-9_.]*(?:::[A-Za-z0-9_]+)*)", 1), F.lit(""))
    kind = F.when(F.col("language") == "rust", "panic").otherwise(F.coalesce(kind, F.lit("UnknownError")))
    message = F.when(F.col("language") == "rust", panic).otherwise(F.coalesce(F.trim(F.regexp_extract(line, r"^[^:]*(?:::[A-Za-z0-9_]+)*:\s(.*)$", 1)), F.lit("")))
    return t.select("trace_id", "language", kind.alias("error_type"), message.alias("message"))


def category(error_type: Column, message: Column) -> Column:
    """The first category one of whose words is in type and message."""
    text = F.lower(F.concat_ws(" ", error_type, message))
    out = None
    for name, words in CATEGORIES.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w.lower())
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def severity(category_: Column) -> Column:
    out = F.lit("medium")
    for name, s in SEVERITY.items():
        out = F.when(category_ == name, s).otherwise(out)
    return out


def root_causes(errors_: DataFrame, mapped: DataFrame) -> DataFrame:
    """(trace_id, category, severity, confidence, likely_cause, suggested_fix) of errors; mapped: (trace_id, frame_index, node_id or null).

    Confidence is 0.5, and 0.2 for a known category, 0.2 for a first frame with a node, 0.1 for a message over 10 characters.
    """
    first = mapped.filter((F.col("frame_index") == 0) & F.col("node_id").isNotNull()).select("trace_id", F.lit(True).alias("_first")).distinct()
    out = errors_.join(first, "trace_id", "left").withColumn("category", category(F.col("error_type"), F.col("message")))
    some = lambda c, v: F.when(c, v).otherwise(0.0)
    conf = 0.5 + some(F.col("category") != "unknown", 0.2) + some(F.col("_first").isNotNull(), 0.2) + some(F.length("message") > 10, 0.1)
    cause, fix = F.lit(""), F.lit("")
    for name, (a, b) in ADVICE.items():
        cause, fix = F.when(F.col("category") == name, a).otherwise(cause), F.when(F.col("category") == name, b).otherwise(fix)
    return out.select("trace_id", "language", "error_type", "message", "category", severity(F.col("category")).alias("severity"), F.round(F.least(conf, F.lit(1.0)), 6).alias("confidence"), cause.alias("likely_cause"), fix.alias("suggested_fix"))


def map_frames(frames_: DataFrame, nodes: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """(trace_id, frame_index, node_id, how): by location, else by name, else by meaning; null if none finds one.

    semantic: (lang, name, id), the best hit of a search for "function <name>", "class <class>" or "module <file>" texts (``frame_texts``).
    """
    from .lookup import nodes_at, nodes_named

    f = frames_.withColumn("_path", F.translate("file_path", "\\", "/"))
    place = f.filter(F.col("_path").isNotNull() & F.col("line_number").isNotNull()).select(F.col("_path").alias("path"), F.col("line_number").alias("line"), F.col("language").alias("lang"))
    at = nodes_at(place, nodes).select(F.col("_lang").alias("language"), "_path", F.col("_line").alias("line_number"), F.col("id").alias("_p"))
    out = f.join(save(at, "at"), ["language", "_path", "line_number"], "left")
    rest = out.filter(F.col("_p").isNull() & F.col("function_name").isNotNull()).select(F.col("language").alias("lang"), F.col("function_name").alias("name"))
    named = nodes_named(rest, nodes).select(F.col("lang").alias("language"), F.col("name").alias("function_name"), F.col("id").alias("_n"))
    out = out.join(save(named, "named"), ["language", "function_name"], "left")
    if semantic is None:
        out = out.withColumn("_s", F.lit(None).cast("string"))
    else:
        s = semantic.groupBy(F.col("lang").alias("language"), F.col("name").alias("_text")).agg(F.min("id").alias("_s"))
        out = out.withColumn("_text", frame_text()).join(s, ["language", "_text"], "left")
    how = F.when(F.col("_p").isNotNull(), "location").when(F.col("_n").isNotNull(), "name").when(F.col("_s").isNotNull(), "semantic")
    return out.select("trace_id", "frame_index", F.coalesce("_p", "_n", "_s").alias("node_id"), how.alias("how"))


def frame_text() -> Column:
    """What a frame is searched by, when neither its place nor its name is known."""
    part = lambda word, c: F.concat(F.lit(f"{word} "), F.col(c))
    return F.concat_ws(" ", part("function", "function_name"), part("class", "class_name"), part("module", "module"))


def with_snippets(frames_: DataFrame, files: DataFrame, context: int = 5) -> DataFrame:
    """Frames with the source around their line, from files (file_path, text); null where there is no such file."""
    from .blocks import snippet

    texts = files.select("file_path", "text")
    got = snippet(frames_.join(texts, "file_path").select("trace_id", "frame_index", "text", F.col("line_number").alias("start_line"), F.col("line_number").alias("end_line")), context)
    return frames_.join(got.select("trace_id", "frame_index", "snippet"), ["trace_id", "frame_index"], "left")


def similar_issues(traces: DataFrame, past: DataFrame, top: int = 5) -> DataFrame:
    """(trace_id, issue_id, score): past errors (issue_id, error_type, message) of the same type, by shared words of the message.

    Words meet by equality; score is the Jaccard similarity of the messages' words, and 1 for the same message.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\W+"), lambda x: F.length(x) > 2))
    mine = errors(traces).select("trace_id", "error_type", words(F.col("message")).alias("w"))
    old = past.select("issue_id", "error_type", words(F.col("message")).alias("v"))
    a = mine.select("trace_id", "error_type", F.size("w").alias("n"), F.explode("w").alias("word"))
    b = old.select("issue_id", "error_type", F.size("v").alias("m"), F.explode("v").alias("word"))
    both = a.join(b, ["error_type", "word"]).groupBy("trace_id", "issue_id", "n", "m").agg(F.count(F.lit(1)).alias("c"))
    scored = both.withColumn("score", F.round(F.col("c") / (F.col("n") + F.col("m") - F.col("c")), 6))
    n = F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc("score"), "issue_id"))
    return scored.withColumn("_n", n).filter(F.col("_n") <= top).select("trace_id", "issue_id", "score")


def report(traces: DataFrame, nodes: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """One row per trace: its error, root cause, related nodes, numbers of frames and of mapped frames, and a one-line summary."""
    f = save(frames(traces), "frames")  # each step below reads them
    mapped = map_frames(f, nodes, semantic)
    counts = mapped.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("total_frames"), F.count("node_id").alias("mapped_frames"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("node_id").isNotNull(), F.struct("frame_index", "node_id")))), lambda x: x["node_id"]).alias("related"),
    )
    out = root_causes(errors(traces), mapped).join(counts, "trace_id", "left").fillna(0, ["total_frames", "mapped_frames"])
    out = out.withColumn("related", F.coalesce("related", F.array().cast("array<string>")))
    line = F.concat_ws(" | ", F.concat("error_type", F.lit(": "), "message"), F.concat(F.lit("category: "), "category"), F.concat(F.lit("frames: "), F.col("mapped_frames").cast("string"), F.lit("/"), F.col("total_frames").cast("string")))
    return out.withColumn("summary", line)


def report_markdown(reports: DataFrame) -> DataFrame:
    """(trace_id, value): a report as Markdown."""
    part = lambda title, c: F.concat(F.lit(f"**{title}:** "), c)
    head = F.concat(F.lit("# "), "error_type", F.lit("\n"))
    rows = [head, part("Message", F.col("message")), part("Language", F.col("language")), part("Category", F.concat("category", F.lit(" ("), "severity", F.lit(")"))), part("Confidence", F.format_number("confidence", 2))]
    rows += [part("Likely cause", F.col("likely_cause")), part("Suggested fix", F.col("suggested_fix")), part("Frames", F.concat(F.col("mapped_frames").cast("string"), F.lit(" of "), F.col("total_frames").cast("string"), F.lit(" mapped")))]
    return reports.select("trace_id", F.concat_ws("\n", *rows).alias("value"))


def report_json(reports: DataFrame) -> DataFrame:
    return reports.select("trace_id", F.to_json(F.struct(*[F.col(c) for c in reports.columns])).alias("value"))
