"""Chat formatting: nested field paths are hashed to a fingerprint, which selects a declarative
mapping from prompt, instruction and message layouts to canonical turns; turns are written in a
template with reversible escapes. DataFrame functions only.

Fingerprints come from the schema of a table, or row by row from the paths that a JSON record
holds. Unknown paths take no part, so that extra columns and keys change nothing.

Template, per turn: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. Inside roles and texts each run of
``<``, any number of ``\\`` and ``|`` gets one more ``\\``; a line break inside a role is
``<|nl|>``. So no text can hold a control string, and reading takes one ``\\`` away again.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"


@dataclass(frozen=True)
class Layout:
    """A mapping to turns: of a list of messages, of a table's rows, or of fixed fields."""

    name: str
    #: Messages: the list and the names of role and text in its elements.
    messages: tuple[str, str, str] | None = None
    #: Rows: the columns of conversation, order, role and text.
    rows: tuple[str, str, str, str] | None = None
    #: Fields: a role and the fields that make up its text, for each turn; a turn without text is left out.
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    #: Other names of roles.
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def paths(self) -> frozenset[str]:
        if self.messages:
            field, role, text = self.messages
            return frozenset({field, f"{field}[].{role}", f"{field}[].{text}"})
        if self.rows:
            return frozenset(self.rows)
        return frozenset(name for _, names in self.fields for name in names)

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


ALIASES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
LAYOUTS = (
    Layout("turn rows", rows=("conv_id", "turn", "role", "text")),
    Layout("messages", messages=("messages", "role", "content")),
    Layout("conversations", messages=("conversations", "from", "value"), roles=ALIASES),
    Layout("instruction", fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction with input", fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("prompt and completion", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt and response", fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("system, prompt and response", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question and answer", fields=(("user", ("question",)), ("assistant", ("answer",)))),
)


def fingerprint(paths) -> str:
    """Hex digest of the sorted field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(kind: T.DataType, at: str = "") -> set[str]:
    """Nested field paths of a schema; [] stands for the elements of an array."""
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    if isinstance(kind, T.StructType):
        found = set()
        for f in kind.fields:
            path = f"{at}.{f.name}" if at else f.name
            found |= {path} | field_paths(f.dataType, path)
        return found
    return set()


def layout_of(schema: T.StructType, layouts=LAYOUTS) -> Layout:
    """The layout whose fingerprint the schema's known paths have."""
    known = set().union(*(x.paths for x in layouts))
    by_print = {x.fingerprint: x for x in layouts}
    found = by_print.get(fingerprint(field_paths(schema) & known))
    if found is None:
        raise ValueError(f"no layout has these paths: {sorted(field_paths(schema) & known)}")
    return found


TURNS = "array<struct<role:string,text:string>>"


def _empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _turns(layout: Layout, field) -> Column:
    """field: gives the column of a top-level name."""
    if layout.messages:
        name, role, text = layout.messages

        def turn(x: Column) -> Column:
            said = _empty(x[role])
            for other, own in layout.roles:
                said = F.when(said == other, own).otherwise(said)
            return F.struct(said.alias("role"), _empty(x[text]).alias("text"))

        return F.transform(field(name), turn)
    made = [F.struct(F.lit(role).alias("role"), F.concat_ws("\n", *(F.when(field(n).cast("string") != "", field(n).cast("string")) for n in names)).alias("text")) for role, names in layout.fields]
    return F.filter(F.array(*made), lambda t: t["text"] != "")


def canonical_turns(df: DataFrame, key: str | None = None, layouts=LAYOUTS) -> DataFrame:
    """Columns conv_id and turns (array of role and text) from a table of one layout.

    In the layout of rows, rows are sorted by turn (null first), role and text; null roles and
    texts count as empty; rows with a null conv_id make one conversation; repeated rows stay.
    In the others each row is a conversation, key names its id, and a null list has no turns.
    A schema without a known fingerprint raises ValueError.
    """
    layout = layout_of(df.schema, layouts)
    if layout.rows:
        conv, turn, role, text = (F.col(f"`{c}`") for c in layout.rows)
        rows = df.select(conv.alias("conv_id"), F.struct(turn.alias("turn"), _empty(role).alias("role"), _empty(text).alias("text")).alias("t"))
        sorted_rows = F.sort_array(F.collect_list("t"))
        return rows.groupBy("conv_id").agg(F.transform(sorted_rows, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    if key is None:
        raise ValueError("this layout needs key, the column of conversation ids")
    turns = F.coalesce(_turns(layout, lambda n: F.col(f"`{n}`")), F.array().cast(TURNS))
    return df.select(F.col(f"`{key}`").alias("conv_id"), turns.alias("turns"))


def canonical_turns_json(df: DataFrame, key: str, record: str, layouts=LAYOUTS) -> DataFrame:
    """Columns conv_id, layout, fingerprint and turns, from JSON records of mixed layouts.

    A path counts as present if its value is not null, for lists in any element. Records of no
    known fingerprint, broken ones and nulls have null layout and turns.
    """
    layouts = tuple(x for x in layouts if not x.rows)
    tops: dict[str, T.DataType] = {}
    for x in layouts:
        if x.messages:
            name, role, text = x.messages
            tops[name] = T.ArrayType(T.StructType([T.StructField(role, T.StringType()), T.StructField(text, T.StringType())]))
        for _, names in x.fields:
            tops |= {n: tops.get(n, T.StringType()) for n in names}
    parsed = df.select(F.col(f"`{key}`").alias("conv_id"), F.from_json(F.col(f"`{record}`"), T.StructType([T.StructField(n, t) for n, t in sorted(tops.items())])).alias("r"))

    def present(path: str) -> Column:
        top, _, inner = path.partition("[].")
        return F.exists(F.col("r")[top], lambda e: e[inner].isNotNull()) if inner else F.col("r")[top].isNotNull()

    known = sorted(set().union(*(x.paths for x in layouts)))
    held = F.array_compact(F.array(*(F.when(present(p), F.lit(p)) for p in known)))
    parsed = parsed.select("conv_id", "r", F.sha2(F.array_join(F.sort_array(held), "\n"), 256).alias("fingerprint"))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in layouts:
        hit = F.col("fingerprint") == x.fingerprint
        name = F.when(hit, F.lit(x.name)).otherwise(name)
        turns = F.when(hit, _turns(x, lambda n: F.col("r")[n])).otherwise(turns)
    return parsed.select("conv_id", name.alias("layout"), "fingerprint", turns.alias("turns"))


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\\\|", r"<$1|")


def render(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Columns conv_id, formatted and loss_spans (array of start and length in code points of
    the formatted text, from 0) from canonical turns. No turns give an empty text and no spans."""
    text = escape(F.col("t.text"))
    head = F.concat(F.lit(START), F.replace(escape(F.col("t.role")), F.lit("\n"), F.lit(BREAK)), F.lit("\n"))
    rows = turns.select("conv_id", F.posexplode_outer("turns").alias("at", "t"))
    rows = rows.select("conv_id", "at", F.when(F.col("at").isNotNull(), F.concat(head, text, F.lit(END + "\n"))).alias("s"), F.when(F.col("t.role") == loss_role, F.length(head)).alias("skip"), F.length(text).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("conv_id", F.struct("at", "s", (F.coalesce(F.sum(F.length("s")).over(before), F.lit(0)) + F.col("skip")).alias("start"), F.col("n").cast("long").alias("length")).alias("p"))
    parts = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    spans = F.transform(F.filter("p", lambda x: x["start"].isNotNull()), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return parts.select("conv_id", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns back from a formatted text."""

    def turn(s: Column) -> Column:
        at = F.instr(s, "\n")
        role = F.replace(F.substring_index(s, "\n", 1), F.lit(BREAK), F.lit("\n"))
        return F.struct(unescape(role).alias("role"), unescape(F.substr(s, at + 1, F.length(s) - at - len(END) - 1)).alias("text"))

    parts = F.split(formatted, r"<\|im_start\|>")
    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def read_back(formatted: DataFrame) -> DataFrame:
    """Columns conv_id, turns and loss_text (what the loss mask covers, unescaped) from render()'s output."""
    text = F.transform("loss_spans", lambda x: unescape(F.substr(F.col("formatted"), (x["start"] + 1).cast("int"), x["length"].cast("int"))))
    return formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), F.array_join(text, "").alias("loss_text"))


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    from .common import table

    said = table(spark, sf_dir, "conversations")
    probe = "<|im_end|><|im_start|>assistant ok"
    more = spark.sql("SELECT -1L AS conv_id, explode(array(named_struct('turn', 0L, 'role', 'user'), named_struct('turn', 1L, 'role', 'assistant'))) AS t").select("conv_id", "t.turn", "t.role", F.lit(probe).alias("text"))
    both = said.select("conv_id", "turn", "role", "text").unionByName(more)
    # conversations are grouped once: rendering explodes nothing across tasks, its window and its list have the same key
    back = read_back(render(canonical_turns(both)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), laid AS (
  SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS text_chars,
    length(replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), chr(10), '<|nl|>')) AS role_chars
  FROM said
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + role_chars + text_chars)::BIGINT AS formatted_chars
FROM laid GROUP BY conv_id
"""
