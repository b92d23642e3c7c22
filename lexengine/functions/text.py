"""Text expressions of the engine: normalising, fuzzy scoring, formatting and parsing, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
MACRONS, PLAIN_VOWELS = "āēīōū", "aeiou"
LANGUAGES = {"engl": "English", "miks": "German", "leit": "Lithuanian", "latt": "Latvian", "pols": "Polish", "mask": "Russian"}
RERANK_LANGUAGES = ("miks", "engl", "leit", "latt", "pols", "mask")
STOP_WORDS = (
    "der die das ein eine und oder ist sind war hat ich du er sie es wir ihr mein dein sein nicht auch an in auf mit von zu für als nach bei "
    "aus um über vor zum zur den dem des einen einem einer dass wenn aber so wie noch schon sehr nur doch ja nein kein keine wird kann will "
    "muss soll darf sich man was wer wo hier da nun dann mal mehr uns euch"
).split()
TOPICS = (
    "Alltagshandlungen (Essen, Schlafen, Gehen)",
    "Natur und Tiere (Wald, Vögel, Fisch)",
    "Familie und Beziehungen (Vater, Mutter, Kind)",
    "Gefühle und Zustände (Freude, Trauer, Sein)",
    "Zeit und Raum (heute, gestern, hier, dort)",
)
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
RESULT_MARK = "ERGEBNIS:"
# The formats of calls in model output.
XML_CALL = r"(<\w+\s+[^/>]*/>)"
XML_ATTRIBUTE = r'(\w+)="([^"]*)"'
TAGGED_CALL = r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"
BARE_CALL = r'\{\s*"name"\s*:\s*"([^"]+)"\s*,\s*"arguments"\s*:\s*(\{[^}]*\})\s*\}'
CALL_NAME = r'"name"\s*:\s*"([^"]+)"'
CALL_ARGUMENTS = r'"arguments"\s*:\s*(\{[^}]+\}|\[[^\]]+\])'
FUNCTION_CALL = r"^(\w+)\s*\(\s*([^)]+)\s*\)$"
FUNCTION_ARGUMENT = r'(\w+)\s*=\s*(?:"([^"]*)"|(\d+))'


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def normal(x: Column | str) -> Column:
    """A query word or lemma as the indexes hold it."""
    return F.lower(strip(x))


def fold(x: Column | str) -> Column:
    """Long vowels to plain ones; lower-case precomposed letters only."""
    return F.translate(_c(x), MACRONS, PLAIN_VOWELS)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix, in code points."""
    n = F.least(F.length(a), F.length(b))
    same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1)))
    first = F.nullif(F.array_position(same, F.lit(False)), F.lit(0).cast("long"))
    return F.when(n == 0, F.lit(0)).otherwise(F.coalesce(first - 1, n.cast("long"))).cast("int")


def fuzzy_score(query: Column, candidate: Column, distance: Column) -> Column:
    """How well a candidate within a small edit distance fits the query; higher is better."""
    q, c = F.length(query), F.length(candidate)
    start = F.when((q >= 3) & (c >= 3) & (F.left(query, F.lit(3)) == F.left(candidate, F.lit(3))), 6.0).otherwise(0.0)
    near = F.greatest(F.lit(0), 5 - F.abs(q - c)).cast("double")
    inside = F.when(F.contains(candidate, query), 2.0 * q).when(F.contains(query, candidate), 2.0 * c).otherwise(0.0)
    two = F.when((q >= 2) & (c >= 2) & (F.right(query, F.lit(2)) == F.right(candidate, F.lit(2))), 4.0).otherwise(0.0)
    three = F.when((q >= 3) & (c >= 3) & (F.right(query, F.lit(3)) == F.right(candidate, F.lit(3))), 6.0).otherwise(0.0)
    return 10.0 - 3.0 * distance + start + near + inside + 0.5 * common_prefix(query, candidate) + two + three


def _segment(length: Column, i: int) -> tuple[Column, Column]:
    """Start (from 0) and length of the i-th of three nearly equal segments of a word of some length."""
    sizes = [F.floor((length + k) / 3).cast("int") for k in range(3)]
    return sum(sizes[:i], F.lit(0)), sizes[i]


def segments(x: Column) -> Column:
    """A word's three segments as array<struct<n, i, part>>, with the word's length.

    Two edits leave one of three segments as it is, so a word within edit distance 2 holds it, at most two
    places from its own: segment_keys lists what such a word would hold.
    """
    n = F.length(x)
    parts = []
    for i in range(3):
        start, size = _segment(n, i)
        parts.append(F.struct(n.alias("n"), F.lit(i).alias("i"), F.substr(x, start + 1, size).alias("part")))
    return F.array(*parts)


def segment_keys(x: Column) -> Column:
    """The segments that words within edit distance 2 of x can share with it, as array<struct<n, i, part>>."""
    m = F.length(x)
    keys = []
    for difference in range(-2, 3):
        n = m + difference
        for i in range(3):
            start, size = _segment(n, i)
            for shift in range(-2, 3):
                at = start + shift
                keys.append(F.when((n >= 0) & (at >= 0) & (at + size <= m), F.struct(n.alias("n"), F.lit(i).alias("i"), F.substr(x, at + 1, size).alias("part"))))
    return F.array_distinct(F.filter(F.array(*keys), lambda k: k.isNotNull()))


def clean(x: Column | str) -> Column:
    """Tags dropped, the common character references decoded, white space collapsed."""
    out = F.regexp_replace(_c(x), "<[^>]+>", "")
    for reference, text in ENTITIES:
        out = F.replace(out, F.lit(reference), F.lit(text))
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def word_type(desc: Column | str) -> Column:
    """The first word of a description, lower-cased; empty if it starts with another sign."""
    return F.lower(F.regexp_extract(F.coalesce(_c(desc), F.lit("")), r"^\s*([\p{L}\p{N}_]+)", 1))


def first_translation(translations: Column | str, language: str) -> Column:
    return F.coalesce(F.get(F.try_element_at(_c(translations), F.lit(language)), F.lit(0)), F.lit(""))


def multilang(translations: Column | str) -> Column:
    """First translations that aren't empty, by language, joined by bars."""
    return F.concat_ws(" | ", *[F.nullif(first_translation(translations, x), F.lit("")) for x in RERANK_LANGUAGES])


def entry_line(word: Column, kind: Column, gender: Column, de: Column, en: Column) -> Column:
    """word [type] (gender) : de | en, without the parts that are empty."""
    some = lambda x, made: F.when(F.length(F.coalesce(x, F.lit(""))) > 0, made)
    return F.concat_ws(" ", F.coalesce(word, F.lit("")), some(kind, F.concat(F.lit("["), kind, F.lit("]"))), some(gender, F.concat(F.lit("("), gender, F.lit(")"))), F.concat(F.lit(": "), F.coalesce(de, F.lit(""))), some(en, F.concat(F.lit("| "), en)))


def evaluation_line(word: Column, kind: Column, de: Column, en: Column, lt: Column, lv: Column) -> Column:
    """word [type]: de | en | lt | lv with all parts, empty or not."""
    return F.concat(word, F.lit(" ["), kind, F.lit("]: "), F.concat_ws(" | ", *[F.coalesce(x, F.lit("")) for x in (de, en, lt, lv)]))


def plain_line(word: Column, de: Column, en: Column) -> Column:
    return F.trim(F.concat_ws(" ", *[F.coalesce(x, F.lit("")) for x in (word, de, en)]))


def passage(translations: Column | str) -> Column:
    """Text to embed: language names with their translations, in fixed order."""
    parts = []
    for code, name in LANGUAGES.items():
        words = F.array_join(F.filter(F.coalesce(F.try_element_at(_c(translations), F.lit(code)), F.array().cast("array<string>")), lambda t: F.length(t) > 0), ", ")
        parts.append(F.when(F.length(words) > 0, F.concat(F.lit(f"{name}: "), words)))
    return F.concat_ws("; ", *parts)


def sentence_tokens(x: Column | str) -> Column:
    """Tokens to look up in a sentence: full stops and commas are spaces; of two letters at least."""
    parts = F.split(F.trim(F.regexp_replace(F.translate(_c(x), ".,", "  "), r"\s+", " ")), " ")
    return F.filter(parts, lambda t: F.length(t) >= 2)


def content_words(x: Column | str) -> Column:
    """Distinct lower-cased words of two letters or more that aren't stop words, in order."""
    text = F.regexp_replace(_c(x), r'[.,!?;:"()\[\]{}]', " ")
    words = F.transform(F.split(text, r"\s+"), F.lower)
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t)))


def split_response(x: Column | str, language: str = "de") -> Column:
    """struct(answer, translation): what stands before the first [DE: ...] or [LT: ...], and what is in it."""
    mark = "LT" if language == "lt" else "DE"
    pattern = rf"(?s)\[{mark}:\s*(.+?)\]"
    at = F.regexp_instr(_c(x), F.lit(pattern))
    answer = F.when(at > 0, F.substr(_c(x), F.lit(1), at - 1)).otherwise(_c(x))
    return F.struct(strip(answer).alias("answer"), strip(F.regexp_extract(_c(x), pattern, 1)).alias("translation"))


def reference_parts(desc: Column | str) -> Column:
    """struct(base_form, grammar, source, is_form) of a description such as "↑ Abbai dat [source 61]"."""
    pattern = r"^↑\s+(\S+)\s+([^\[]*?)\s*(?:\[(.+?)\])?$"
    part = lambda n: F.nullif(F.regexp_extract(_c(desc), pattern, n), F.lit(""))
    return F.struct(part(1).alias("base_form"), part(2).alias("grammar"), part(3).alias("source"), F.startswith(_c(desc), F.lit("↑")).alias("is_form"))


def xml_calls(x: Column | str) -> Column:
    """All calls of the form <name key="value" .../> as array<struct<name, arguments map>>."""
    bodies = F.regexp_extract_all(_c(x), F.lit(XML_CALL), F.lit(1))

    def call(b: Column) -> Column:
        keys = F.regexp_extract_all(b, F.lit(XML_ATTRIBUTE), F.lit(1))
        values = F.regexp_extract_all(b, F.lit(XML_ATTRIBUTE), F.lit(2))
        # the last of equal keys holds
        pairs = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys), F.lit(1))), p["k"]))
        return F.struct(F.regexp_extract(b, r"<(\w+)", 1).alias("name"), F.map_from_entries(pairs).alias("arguments"))

    return F.transform(bodies, call)


def flexible_call(x: Column | str) -> Column:
    """struct(name, arguments json) from JSON, a name and arguments somewhere in it, or name(key="value"); null if none fits."""
    text = F.trim(_c(x))
    json_name, json_args = F.get_json_object(text, "$.name"), F.get_json_object(text, "$.arguments")
    any_name = F.nullif(F.regexp_extract(text, CALL_NAME, 1), F.lit(""))
    any_args = F.nullif(F.regexp_extract(text, CALL_ARGUMENTS, 1), F.lit(""))
    fn = F.nullif(F.regexp_extract(text, FUNCTION_CALL, 1), F.lit(""))
    inner = F.regexp_extract(text, FUNCTION_CALL, 2)
    pattern = F.lit(FUNCTION_ARGUMENT)
    keys, texts, numbers = (F.regexp_extract_all(inner, pattern, F.lit(i)) for i in (1, 2, 3))
    pairs = F.transform(keys, lambda k, i: F.concat(F.lit('"'), k, F.lit('":'), F.when(F.length(F.get(numbers, i)) > 0, F.get(numbers, i)).otherwise(F.concat(F.lit('"'), F.replace(F.get(texts, i), F.lit('"'), F.lit('\\"')), F.lit('"')))))
    built = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    made = lambda n, a: F.struct(n.alias("name"), a.alias("arguments"))
    return F.when(json_name.isNotNull() & json_args.isNotNull(), made(json_name, json_args)).when(any_name.isNotNull() & any_args.isNotNull(), made(any_name, any_args)).when(fn.isNotNull(), made(fn, built))


def tagged_calls(x: Column | str) -> Column:
    """Calls in <tool_call> tags, else bare JSON calls, as array<struct<name, arguments>>."""
    tagged = F.transform(F.regexp_extract_all(_c(x), F.lit(TAGGED_CALL), F.lit(1)), flexible_call)
    bare = F.lit(BARE_CALL)
    names, arguments = F.regexp_extract_all(_c(x), bare, F.lit(1)), F.regexp_extract_all(_c(x), bare, F.lit(2))
    loose = F.transform(names, lambda n, i: F.struct(n.alias("name"), F.get(arguments, i).alias("arguments")))
    found = F.filter(tagged, lambda c: c.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(loose)


def result_lines(x: Column | str, only_after_mark: bool = False) -> Column:
    """array<struct<de, pr>> of lines "de;pr", from a response that holds the result mark.

    With only_after_mark only lines after one that is the mark count.
    """
    lines = F.transform(F.split(_c(x), "\n"), lambda t: F.trim(t))
    at = F.array_position(lines, F.lit(RESULT_MARK))
    # slicing past the end gives an empty array
    usable = F.when(at > 0, F.slice(lines, at.cast("int") + 1, F.size(lines))).otherwise(F.array().cast("array<string>")) if only_after_mark else F.when(F.contains(_c(x), F.lit(RESULT_MARK)), lines).otherwise(F.array().cast("array<string>"))
    usable = F.filter(usable, lambda t: F.contains(t, F.lit(";")) & ~F.startswith(t, F.lit(RESULT_MARK[:-1])))
    pairs = F.transform(usable, lambda t: F.struct(F.trim(F.regexp_extract(t, "^([^;]*);(.*)$", 1)).alias("de"), F.trim(F.regexp_extract(t, "^([^;]*);(.*)$", 2)).alias("pr")))
    return F.filter(pairs, lambda p: (F.length(p["de"]) > 0) & (F.length(p["pr"]) > 0))


def loose_result_lines(x: Column | str) -> Column:
    """The fallback where no marked line was found: any "de;pr" line of more than two letters either side that is no example."""
    lines = F.filter(F.transform(F.split(_c(x), "\n"), lambda t: F.trim(t)), lambda t: F.contains(t, F.lit(";")) & ~F.startswith(t, F.lit(RESULT_MARK[:-1])))
    pairs = F.transform(lines, lambda t: F.struct(F.trim(F.regexp_extract(t, "^([^;]*);(.*)$", 1)).alias("de"), F.trim(F.regexp_extract(t, "^([^;]*);(.*)$", 2)).alias("pr")))
    return F.filter(pairs, lambda p: (F.length(p["de"]) > 2) & (F.length(p["pr"]) > 2) & ~F.rlike(F.lower(p["de"]), F.lit("beispiel|example")))


def sse_events(x: Column | str) -> Column:
    """array<struct<event, data>> of the frames of an event stream; data that is no JSON is left out."""
    frames = F.filter(F.split(F.replace(_c(x), F.lit("\r"), F.lit("")), "\n\n"), lambda f: F.length(f) > 0)
    made = F.transform(frames, lambda f: F.struct(F.trim(F.regexp_extract(f, r"(?m)^event: (.*)$", 1)).alias("event"), F.trim(F.regexp_extract(f, r"(?m)^data: (.*)$", 1)).alias("data")))
    return F.filter(made, lambda e: (F.length(e["event"]) > 0) & F.try_parse_json(e["data"]).isNotNull() & (F.length(e["data"]) > 0))


def stream_text(x: Column | str) -> Column:
    """The stream up to and with the first closing call tag."""
    at = F.instr(_c(x), "</tool_call>")
    return F.when(at > 0, F.substr(_c(x), F.lit(1), at + len("</tool_call>") - 1)).otherwise(_c(x))


def topic(seed: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TOPICS]), F.pmod(_c(seed), F.lit(len(TOPICS))).cast("int") + 1)


def render_prompt(template: Column | str, language: Column, tools: Column) -> Column:
    code = F.when(language == "lt", "LT").otherwise("DE")
    return F.replace(F.replace(_c(template), F.lit("{lang_code}"), code), F.lit("{tools}"), tools)


def unwrap_blocks(blocks: Column | str) -> Column:
    """Content blocks (type, text) as one JSON text: a single text block as itself, several as an array; other blocks left out."""
    texts = F.transform(F.filter(_c(blocks), lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: F.when(F.try_parse_json(b["text"]).isNotNull(), b["text"]).otherwise(F.to_json(F.array(b["text"])).substr(F.lit(2), F.length(F.to_json(F.array(b["text"]))) - 2)))
    return F.when(F.size(texts) == 1, F.get(texts, F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")))


def completion_deltas(x: Column | str) -> Column:
    """array<struct<content, reasoning>> of a completion stream's "data:" lines, up to its [DONE]."""
    lines = F.split(F.replace(_c(x), F.lit("\r"), F.lit("")), "\n")
    end = F.array_position(lines, F.lit("data: [DONE]"))
    data = F.filter(F.when(end > 0, F.slice(lines, F.lit(1), end.cast("int") - 1)).otherwise(lines), lambda t: F.startswith(t, F.lit("data: ")))
    deltas = F.transform(data, lambda t: F.substr(t, F.lit(7)))
    known = F.filter(deltas, lambda d: F.try_parse_json(d).isNotNull())
    return F.transform(known, lambda d: F.struct(F.get_json_object(d, "$.choices[0].delta.content").alias("content"), F.get_json_object(d, "$.choices[0].delta.reasoning_content").alias("reasoning")))


def message(messages: dict[str, dict[str, str]], language: Column, key: Column, variables: dict[str, Column] | None = None, default: str = "de") -> Column:
    """A message in a language, else in the default one, else its key, with each {name} replaced once by its variable."""
    table = F.create_map(*[F.lit(x) for lang, texts in messages.items() for name, told in texts.items() for x in (f"{lang} {name}", told)])
    found = F.coalesce(*[F.nullif(F.try_element_at(table, F.concat(lang, F.lit(" "), key)), F.lit("")) for lang in (language, F.lit(default))], key)
    for name, value in (variables or {}).items():
        mark = F.lit("{" + name + "}")
        at = F.position(mark, found)
        found = F.when(at > 0, F.concat(F.substring(found, F.lit(1), at - 1), value, F.substring(found, at + F.length(mark), F.length(found)))).otherwise(found)
    return found


def reader_language(told: Column) -> Column:
    """The language for a reader whose settings name one: lt and de as they are, at and ch are de, other than en is lt, else de."""
    low = F.lower(F.coalesce(told, F.lit("")))
    return F.when(low.startswith("lt"), "lt").when(low.startswith("de") | low.startswith("at") | low.startswith("ch"), "de").when((F.length(low) > 0) & ~low.startswith("en"), "lt").otherwise("de")


def shown(x: Column) -> Column:
    """Text as markup shows it: angle brackets escaped."""
    return F.replace(F.replace(x, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def broken_lines(x: Column) -> Column:
    return F.replace(x, F.lit("\n"), F.lit("<br>"))


def result_row(rank: Column, word: Column, kind: Column, gender: Column, de: Column, score: Column) -> Column:
    """One line of a printed list of results, in columns that longer values widen, but for de, which is cut."""
    wide = lambda x, n: F.concat(x, F.repeat(F.lit(" "), F.greatest(F.lit(n) - F.length(x), F.lit(0))))
    number = F.concat(F.repeat(F.lit(" "), F.greatest(2 - F.length(rank.cast("string")), F.lit(0))), rank.cast("string"))
    marks = F.trim(F.concat_ws(" ", kind, gender))
    return F.concat(number, F.lit(". "), wide(word, 20), F.lit(" ["), wide(marks, 10), F.lit("] "), wide(F.substring(de, 1, 40), 40), F.lit(" | "), F.format_string("%.4f", score))


def completion(identity: Column, model: Column, content: Column, finish: Column, prompt_tokens: Column, completion_tokens: Column) -> Column:
    """A chat completion as services return it, as JSON; usage is empty where its numbers are null."""
    usage = F.when(prompt_tokens.isNotNull() & completion_tokens.isNotNull(), F.to_json(F.struct(prompt_tokens.alias("prompt_tokens"), completion_tokens.alias("completion_tokens"), (prompt_tokens + completion_tokens).alias("total_tokens")))).otherwise("{}")
    one = F.to_json(F.struct(F.lit(0).alias("index"), F.struct(F.lit("assistant").alias("role"), F.coalesce(content, F.lit("")).alias("content"), F.array().cast("array<string>").alias("tool_calls")).alias("message"), finish.alias("finish_reason")))
    head = F.to_json(F.struct(F.concat(F.lit("chatcmpl-"), F.coalesce(identity, F.lit("none"))).alias("id"), F.lit("chat.completion").alias("object"), model.alias("model")))
    return F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"choices":['), one, F.lit('],"usage":'), usage, F.lit("}"))
