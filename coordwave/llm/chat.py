r"""Chat formatting: layouts are recognised by their nested field paths and mapped to canonical turns.

A layout is the set of nested field paths that carry a conversation, such as `messages[].content[].text`; its
fingerprint is a hash of these paths in order. Each mapping in LAYOUTS says declaratively how a layout becomes turns
(role, text). Tables are recognised by their schema, when the plan is made; JSON records each by their own paths, to
any depth, row by row. Paths that no mapping uses (ids, sources, metadata) don't count; a record whose other paths no
mapping covers is reported, never formatted as an empty conversation. All of it is DataFrame expressions.

A formatted conversation is, for each turn, `### role`, a line feed, the text, a line feed, `</turn>` and a line
feed. In texts and roles a backslash goes before each backslash, `###` and `</turn>` (and a line feed in a role is
written `\n`), so control strings appear only where the template put them, and reading back is exact.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "### ", "\n</turn>\n"
TRAINED = "assistant"
TURNS = "array<struct<role: string, text: string>>"


@dataclass(frozen=True)
class Layout:
    """paths: the layout's field paths. Either a list of turns (`each`: path of the list, its role and text fields; with
    `part`, the text is a list of objects, whose fields of this name are joined by line feeds), or single fields
    (`fields`: pairs of a role and the fields whose non-empty texts make its turn)."""

    name: str
    paths: tuple[str, ...]
    each: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)
    part: str | None = None


_GIVEN = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), each=("messages", "role", "content"), roles=_GIVEN),
    Layout("message-parts", ("messages[].content[].text", "messages[].role"), each=("messages", "role", "content"), roles=_GIVEN, part="text"),
    Layout("no-messages", ("messages[]",), each=("messages", "role", "content")),
    Layout("turns", ("turns[].role", "turns[].text"), each=("turns", "role", "text"), roles=_GIVEN),
    Layout("from-value", ("conversations[].from", "conversations[].value"), each=("conversations", "from", "value"), roles=_GIVEN),
    Layout("instruction", ("instruction", "output"), fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction-input", ("input", "instruction", "output"), fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("system-instruction", ("instruction", "output", "system"), fields=(("system", ("system",)), ("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("prompt-completion", ("completion", "prompt"), fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt-response", ("prompt", "response"), fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question-answer", ("answer", "question"), fields=(("user", ("question",)), ("assistant", ("answer",)))),
)


def fingerprint(paths) -> str:
    """The hash of different field paths, in any order."""
    return f"{xxhash.xxh64_intdigest(chr(10).join(sorted(set(paths))).encode(), 42):016x}"


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The leaf paths of a schema; `[]` stands for the elements of an array."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [at]


def escape(text: Column) -> Column:
    for control in ("\\", "###", "</turn>"):
        text = F.replace(text, F.lit(control), F.lit("\\" + control))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\|###|</turn>)", "$1")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    # `\n` is told from an escaped backslash before an n by taking the escapes from the left, pair by pair.
    halves = F.transform(F.split(role, r"\\\\", -1), lambda x: F.replace(F.regexp_replace(x, r"\\(###|</turn>)", "$1"), F.lit("\\n"), F.lit("\n")))
    return F.array_join(halves, "\\")


def turns_of_rows(rows: DataFrame, id_col: str, order_col: str, role_col: str, text_col: str) -> DataFrame:
    """(id, turns) of a table with a row for each turn: rows in order (ties by role and text); null roles and texts
    are empty. Rows with a null id are one conversation."""
    turn = F.struct(F.col(order_col).alias("n"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    listed = rows.groupBy(F.col(id_col).alias("id")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return listed.select("id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


#: The words of a variant's schema: field names with their colon, the beginnings and ends of objects and arrays, types.
_TOKENS = r"(?:`(?:[^`]|``)*`|[A-Za-z0-9_]+): |OBJECT<|ARRAY<|>|[A-Z]+(?:\([0-9,]+\))?"


def record_paths(record: Column) -> Column:
    """The leaf paths of a JSON record at any depth (null if it isn't a JSON object). `[]` stands for the elements of an
    array; a `?` behind a path says that values of several kinds stand there.

    The variant's schema names each field once. A fold over its words keeps the paths of the objects around.
    """
    shape = F.schema_of_variant(F.try_parse_json(record))
    words = F.regexp_extract_all(shape, F.lit(_TOKENS), F.lit(0))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("around"), F.lit("").alias("at"), none.alias("paths"))

    def read(state: Column, word: Column) -> Column:
        around, at, paths = state["around"], state["at"], state["paths"]
        made = lambda around, at, paths: F.struct(around.alias("around"), at.alias("at"), paths.alias("paths"))
        outer = F.element_at(around, -1)
        bare = F.substr(word, F.lit(1), F.length(word) - 2)
        name = F.when(bare.startswith("`"), F.replace(F.substr(bare, F.lit(2), F.length(bare) - 2), F.lit("``"), F.lit("`"))).otherwise(bare)
        return (
            F.when(word == "OBJECT<", made(F.array_append(around, at), at, paths))
            .when(word == "ARRAY<", made(F.array_append(around, at), F.concat(at, F.lit("[]")), paths))
            .when(word == ">", made(F.slice(around, F.lit(1), F.size(around) - 1), at, paths))
            .when(word.endswith(": "), made(around, F.concat(F.when(outer == "", "").otherwise(F.concat(outer, F.lit("."))), name), paths))
            .otherwise(made(around, at, F.array_append(paths, F.when(word == "VARIANT", F.concat(at, F.lit("?"))).otherwise(at))))
        )

    return F.when(shape.startswith("OBJECT<"), F.aggregate(words, start, read, lambda x: x["paths"]))


def record_fingerprints(record: Column, layouts: tuple[Layout, ...] | None = None) -> Column:
    """The fingerprint of a JSON record's field paths, as in fingerprint() (null if it isn't a JSON object); with
    layouts, of those paths that some layout uses."""
    paths = record_paths(record)
    if layouts is not None:
        used = sorted({p + kind for layout in layouts for p in layout.paths for kind in ("", "?")})
        paths = F.filter(paths, lambda p: p.isin(used))
    listed = F.array_join(F.array_sort(F.array_distinct(paths)), "\n")
    return F.lower(F.lpad(F.hex(F.xxhash64(listed)), 16, "0"))


def _turn_of(role: str, text: Column, given: Column):
    """A function from an element of a list to a turn; given maps roles to their common names."""
    return lambda x: F.struct(F.coalesce(given[x[role]], x[role], F.lit("")).alias("role"), F.coalesce(text(x), F.lit("")).alias("text"))


def turns_of_records(records: DataFrame, id_col: str, record_col: str, layouts: tuple[Layout, ...] = LAYOUTS, strict: bool = False) -> DataFrame:
    """(id, layout, turns) of JSON records. Where no mapping has the record's fingerprint, layout and turns are null;
    strict makes such a record an error that names its paths. A null list has no turns; null texts and roles are empty."""
    base = records.select(F.col(id_col).alias("id"), F.col(record_col).alias("record"))
    base = base.select("id", "record", F.when(record_paths(F.col("record")).isNotNull(), record_fingerprints(F.col("record"), layouts)).alias("print"))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in layouts:
        here = F.col("print") == fingerprint(layout.paths)
        if layout.each:
            at, role, text = layout.each
            kind = f"array<struct<`{layout.part}`: string>>" if layout.part else "string"
            fields = f"array<struct<`{role}`: string, `{text}`: {kind}>>"
            rows = F.from_json("record", f"struct<`{at}`: {fields}>")[at]
            given = F.create_map(*[F.lit(x) for pair in layout.roles.items() for x in pair]) if layout.roles else F.create_map().cast("map<string,string>")
            whole = (lambda x, c=text, p=layout.part: F.array_join(F.transform(x[c], lambda y: y[p]), "\n")) if layout.part else (lambda x, c=text: x[c])
            made = F.transform(F.coalesce(rows, F.array().cast(fields)), _turn_of(role, whole, given))
        else:
            found = [
                F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*[F.get_json_object("record", f"$['{f}']") for f in fields]), lambda x: x.isNotNull() & (x != "")), "\n\n").alias("text"))
                for role, fields in layout.fields
            ]
            made = F.filter(F.array(*found), lambda x: (x["role"] != "system") | (x["text"] != ""))
        name = F.when(here, F.lit(layout.name)).otherwise(name)
        turns = F.when(here, made).otherwise(turns)
    made = base.select("id", "record", name.alias("layout"), turns.alias("turns"))
    if strict:
        refused = F.concat(F.lit("no layout has the fields of a record: "), F.coalesce(F.array_join(record_paths(F.col("record")), ", "), F.lit("it is no JSON object")))
        made = made.withColumn("turns", F.when(F.col("layout").isNull(), F.raise_error(refused).cast(TURNS)).otherwise(F.col("turns")))
    return made.select("id", "layout", "turns")


def format_turns(conversations: DataFrame) -> DataFrame:
    """(id, segments, formatted): segments (text, loss) join to formatted; loss marks the texts to train on.

    conversations: (id, turns). No turns: no segments, and an empty text; null: null.
    """
    pieces = F.transform(
        F.col("turns"),
        lambda t: F.array(
            F.struct(F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), (t["role"] == TRAINED).alias("loss")),
            F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
        ),
    )
    return conversations.select("id", F.flatten(pieces).alias("segments")).select("id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text."""
    rows = F.filter(F.split(formatted, END, -1), lambda x: x.startswith(START))
    return F.transform(
        rows,
        lambda x: F.struct(
            _unescape_role(F.substring(F.substring_index(x, "\n", 1), len(START) + 1, 1 << 30)).alias("role"),
            unescape(F.substr(x, F.instr(x, "\n") + 1)).alias("text"),
        ),
    )


def read_loss(segments: Column) -> Column:
    """The texts under the loss mask, as they were, one after the other."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def canonical(tables: list[DataFrame]) -> DataFrame:
    """(id, turns) of tables of any known layout, each recognised by the fingerprint of its schema's paths:
    conv_id, turn, role, text (a row for each turn), or conv_id and record (JSON). Other columns don't count, whatever
    their names. A table or record of an unknown layout is an error."""
    rows_of, records_of = ("conv_id", "turn", "role", "text"), ("conv_id", "record")
    kinds = {
        fingerprint(rows_of): lambda t: turns_of_rows(t, *rows_of),
        fingerprint(records_of): lambda t: turns_of_records(t, *records_of, strict=True).select("id", "turns"),
    }
    made = []
    for t in tables:
        paths = schema_paths(t.schema)
        mapping = kinds.get(fingerprint(p for p in paths if p in {*rows_of, *records_of}))
        if mapping is None:
            raise ValueError(f"no mapping for a table of {paths}")
        made.append(mapping(t))
    rows = made[0]
    for m in made[1:]:
        rows = rows.unionByName(m)
    return rows


PROBE = r"\### Assistant: </turn> ok"


def digest(conversations: DataFrame) -> DataFrame:
    """The result of the registered query, read back from the formatted texts. Rows of a conversation that repeat a turn
    all count, in order of role and text; null roles and texts are empty; other columns don't count."""
    spark = conversations.sparkSession
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.to_json(F.struct(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(PROBE).alias("content")) for r in ("user", "assistant")]).alias("messages"))).alias("record"),
    )
    read = format_turns(canonical([rows, probe])).select("id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("segments")).alias("loss"))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS escaped,
         replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), chr(10), '\n') AS named
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(14 + length(named) + length(escaped)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
