"""Chat records of many layouts as canonical turns, and a reversible template with a loss mask.

The layout of a JSON record is found by its fingerprint: the hash of its nested field paths,
without values and their types. Each known fingerprint selects a declarative ``Mapping`` from
fields to turns. All of it is built-in functions; nothing leaves the JVM.

The template writes a turn as ``### role: text</turn>`` and a line feed. Inside texts a
backslash is doubled, ``##`` becomes ``#\\#`` and ``</turn>`` becomes ``<\\/turn>``, so neither
marker can occur in a text, and ``\\x`` reads back as ``x``.

Defined results: a null text or role is empty; an unknown layout has null turns and an empty
format; a record without turns formats to an empty text; turns that tie keep all their rows,
ordered by role and text; a null conversation id is one conversation; columns beside those
named are ignored; an empty table gives an empty result.

Spark's parser gives null for a string of over 20,000,000 characters and for a variant above 128 MiB. Such
records are read again without the first limit, and then with a variant for each role and text. What
is still too long (one text above 128 MiB) or, at that size, not of its mapping's types raises an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TURNS = "array<struct<role: string, text: string>>"
_LONG = {"maxStringLen": str(2**31 - 1)}
#: A record of no more bytes has a variant below 128 MiB: a value takes less than eight times the bytes of its JSON.
_SMALL = 16 << 20


@dataclass(frozen=True)
class Mapping:
    """Turns of one layout: ``shape`` are its nested field paths; ``fields`` gives (role, path) of single texts, or ``each`` the path of a list with the paths of role and text inside.

    ``roles`` gives canonical names of roles that the layout names otherwise; other roles stay as given.
    """

    name: str
    shape: str
    fields: tuple[tuple[str, str], ...] = ()
    each: tuple[str, str, str] | None = None
    roles: tuple[tuple[str, str], ...] = ()

    def turns(self, record: Column) -> Column:
        if self.each:
            path, role, text = self.each
            found = F.variant_get(record, f"$.{path}", f"array<struct<{role}: string, {text}: string>>")
            return F.transform(found, lambda x: F.struct(self._role(x[role]).alias("role"), F.coalesce(x[text], F.lit("")).alias("text")))
        return F.array(*[F.struct(F.lit(role).alias("role"), F.coalesce(F.variant_get(record, f"$.{path}", "string"), F.lit("")).alias("text")) for role, path in self.fields])

    def _role(self, x: Column) -> Column:
        out = F.coalesce(x, F.lit(""))
        for given, canonical in self.roles:
            out = F.when(x == given, F.lit(canonical)).otherwise(out)
        return out

    @property
    def names(self) -> str | None:
        """The sorted names of a record's fields, or null where the mapping leaves some out or goes deeper than ``in_parts`` can."""
        if self.each:
            path, role, text = self.each
            return path if self.shape == f"OBJECT<{path}: ARRAY<OBJECT<{', '.join(sorted((role, text)))}>>>" else None
        names = ", ".join(sorted(path for _, path in self.fields))
        return names if self.shape == f"OBJECT<{names}>" else None

    def in_parts(self, json: Column) -> tuple[Column, Column]:
        """Of a record too large for one variant: a variant of its shape, with empty texts, and its turns."""
        def short(part: Column) -> Column:
            return F.transform_values(part, lambda _, v: F.when(F.schema_of_variant(v) == "STRING", F.parse_json(F.lit('""'))).otherwise(v))

        def text(part: Column, name: str) -> Column:
            return F.variant_get(F.element_at(part, name), "$", "string")

        options = {**_LONG, "mode": "FAILFAST"}
        if self.each:
            path, role, said = self.each
            parts = F.from_json(json, f"struct<{path}: array<map<string, variant>>>", options)[path]
            turns = F.transform(parts, lambda x: F.struct(self._role(text(x, role)).alias("role"), F.coalesce(text(x, said), F.lit("")).alias("text")))
            return F.to_variant_object(F.struct(F.transform(parts, short).alias(path))), turns
        parts = F.from_json(json, "map<string, variant>", options)
        turns = F.array(*[F.struct(F.lit(role).alias("role"), F.coalesce(text(parts, path), F.lit("")).alias("text")) for role, path in self.fields])
        return F.to_variant_object(short(parts)), turns


#: Names that the layout with "from" and "value" gives to roles.
_SHARED_NAMES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
MAPPINGS = (
    Mapping("messages", "OBJECT<messages: ARRAY<OBJECT<content, role>>>", each=("messages", "role", "content")),
    Mapping("conversations", "OBJECT<conversations: ARRAY<OBJECT<from, value>>>", each=("conversations", "from", "value"), roles=_SHARED_NAMES),
    Mapping("prompt", "OBJECT<completion, prompt>", fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("instruction", "OBJECT<instruction, output>", fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input", "OBJECT<input, instruction, output>", fields=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("question", "OBJECT<question, response, system_prompt>", fields=(("system", "system_prompt"), ("user", "question"), ("assistant", "response"))),
)


def field_paths(record: Column) -> Column:
    """The nested field paths of a variant, sorted by name: its schema without the types of values."""
    return F.regexp_replace(F.schema_of_variant(record), r": (?!OBJECT<|ARRAY<)[A-Z]+(?:\(\d+,\s?\d+\))?", "")


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(paths)


def canonical_turns(records: DataFrame, json_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS, long_records: bool = True) -> DataFrame:
    """The input with ``layout`` (the mapping that its fingerprint selects, or null) and ``turns``.

    ``long_records=False`` says that all records are known to have 16 MiB at most, and leaves out the reading of longer ones.
    """
    json, record = F.col(json_col), F.col("_record")
    parsed = records.withColumn("_record", F.coalesce(F.try_parse_json(json), F.from_json(json, "variant", _LONG)) if long_records else F.try_parse_json(json))
    found = fingerprint(field_paths(record))
    usual = F.lit(True)
    if long_records:  # only for what is too large for one variant
        names = F.col("_names")
        usual = names.isNull()
        parsed = parsed.withColumn("_names", F.when(record.isNull() & (F.octet_length(json) > _SMALL), F.array_join(F.array_sort(F.json_object_keys(json)), ", ")))
        if not all(m.names for m in mappings):
            found = F.when(names.isNotNull(), F.raise_error(F.lit("a record is too large for a variant"))).otherwise(found)
        for m in mappings:
            if m.names:
                found = F.when(names == m.names, fingerprint(field_paths(m.in_parts(json)[0]))).otherwise(found)
    parsed = parsed.withColumn("_print", found)
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(_TURNS)
    for m in mappings:
        this = F.col("_print") == fingerprint(F.lit(m.shape))
        layout = F.when(this, F.lit(m.name)).otherwise(layout)
        turns = F.when(this & usual, m.turns(record)).otherwise(turns)
        if long_records and m.names:
            turns = F.when(this & ~usual, m.in_parts(json)[1]).otherwise(turns)
    return parsed.withColumns({"layout": layout, "turns": turns}).drop("_record", "_names", "_print")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("##"), F.lit("#\\#"))
    return F.replace(out, F.lit("</turn>"), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(": "), F.lit(":\\ "))


def format_turns(records: DataFrame, turns_col: str = "turns") -> DataFrame:
    """The input with ``formatted`` and ``loss_spans``: start (0-based) and length, in code points, of every assistant text in it."""
    parts = F.transform(F.coalesce(F.col(turns_col), F.array().cast(_TURNS)), lambda t: F.struct(t.role.alias("role"), F.concat(F.lit("### "), _escape_role(t.role), F.lit(": ")).alias("head"), escape(t.text).alias("body")))
    end = "</turn>\n"
    with_parts = records.withColumn("_parts", parts)
    formatted = F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(end))), "")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: long, length: long>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        at = acc["at"] + F.length(p["head"])
        span = F.array(F.struct(at.cast("long").alias("start"), F.length(p["body"]).cast("long").alias("length")))
        return F.struct((at + F.length(p["body"]) + len(end)).cast("long").alias("at"), F.when(p["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("_parts", start, step, lambda acc: acc["spans"])
    return with_parts.withColumns({"formatted": formatted, "loss_spans": spans}).drop("_parts")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text."""
    parts = F.slice(F.split(formatted, r"</turn>\n"), 1, F.greatest(F.size(F.split(formatted, r"</turn>\n")) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        cut = F.instr(p, ": ")
        return F.struct(unescape(F.substring(p, F.lit(5), cut - 5)).alias("role"), unescape(F.substring(p, cut + 2, F.length(p))).alias("text"))

    return F.transform(parts, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def conversation_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record): the JSON record of each conversation, in one of several layouts by the roles of its turns."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    held = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    roles = F.array_join("t.role", "\n")
    text = lambda k: F.col("t")[k]["content"]
    messages = F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")))
    record = F.when(roles == "user\nassistant", F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion"))))
    record = record.when(roles == "system\nuser\nassistant", F.to_json(F.struct(text(0).alias("system_prompt"), text(1).alias("question"), text(2).alias("response"))))
    return held.select("conv_id", record.otherwise(messages).alias("record"))


def chat_digests(conversations: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted text: counts and digests of turns and of the text under the loss mask."""
    said = "\\### Assistant: </turn> ok"
    spark = conversations.sparkSession
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(said).alias("text"))
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    # a JSON record takes at most six bytes for one of a text, and little for each turn; the sums are made before the shuffle
    size = rows.groupBy("conv_id").agg((6 * F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("role"), F.lit(0)) + 16).cast("long")).alias("n")).agg(F.max("n")).first()[0]
    formatted = format_turns(canonical_turns(conversation_records(rows), long_records=size > _SMALL - 1024).select("conv_id", "layout", "turns")).select("conv_id", "layout", "formatted", "loss_spans")
    back = formatted.withColumns({"turns": read_turns(F.col("formatted")), "loss": loss_text(F.col("formatted"), F.col("loss_spans"))})
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
