"""Chat formatting: typed content parts flattened by a visitor.

A message's content is a list of typed parts (text, image, audio, document) or
a plain string, which is one text part.  ``Flatten`` visits the parts in order:
texts are escaped and appended, every other part becomes a numbered placeholder
``<|kind:i|>`` in the place where it stands, its reference is recorded as an
attachment, and the tokens it will expand to are counted (image patches, audio
frames, document pages).  A turn is ``### role: content</turn>`` and a line
feed.  Control strings and backslashes inside roles and texts get a backslash
in front, so a reader that skips escaped strings finds the template's own ones
only, and taking the backslashes away gives the texts back.

Spark orders the messages by (conversation, turn) in ranges, so a conversation
with a third of all rows is spread over many tasks.  A task writes its part of
each conversation as chunks of about ``CHUNK`` characters (whole turns), with
the loss spans (code points of the chunk) of the roles that are trained on.
Conversations of one chunk are read where they are; only those with several
are brought together, chunk by chunk in order, because a digest over a
conversation is one sequence.  Nothing holds more than a chunk.

Defined cases: a null or empty text is an empty turn; a null role is an empty
role; null conversation ids form one conversation, null turns come first; rows
with the same turn are ordered by role and text, repeated rows stay repeated;
a turn of any length is formatted whole (a chunk of its own); parts without a
type or of an unknown one become ``other`` placeholders of no tokens, null
parts are skipped, neighbouring text parts read back as one; an empty table
gives an empty result; columns other than the four named ones are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estimark.llm import words as W
from estimark.session import materialize

CHUNK = 1 << 20  # characters after which a chunk ends
PATCH = 28  # pixels a side of the square that one image token covers
IMAGE_TOKENS = 256  # of an image without a size
AUDIO_RATE = 12.5  # tokens a second
PAGE_TOKENS = 512  # of a document page
LOSS_ROLES = ("assistant",)

_CONTROL = re.compile(r"\\|###|</turn>|<\||:")
_CONTROL_TEXT = re.compile(r"\\|###|</turn>|<\|")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|<\||:)")
_ROLE = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.S)
_END = re.compile(r"\\.|</turn>\n", re.S)
_PLACE = re.compile(r"\\.|<\|(image|audio|document|other):(\d+)\|>", re.S)
_PART_FIELDS = ("type", "text", "ref", "width", "height", "seconds", "pages")


def escape(text: str, control: re.Pattern = _CONTROL_TEXT) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


class Flatten:
    """Visitor over typed parts: the flattened content, and the attachments in order."""

    def __init__(self, first: int = 0):
        self.first, self.out, self.attachments = first, [], []

    def visit(self, part: dict) -> None:
        kind = part.get("type")
        getattr(self, f"visit_{kind}" if kind in ("text", "image", "audio", "document") else "visit_other")(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        w, h = part.get("width"), part.get("height")
        self.place("image", part, math.ceil(w / PATCH) * math.ceil(h / PATCH) if w and h else IMAGE_TOKENS)

    def visit_audio(self, part: dict) -> None:
        self.place("audio", part, math.ceil((part.get("seconds") or 0) * AUDIO_RATE))

    def visit_document(self, part: dict) -> None:
        self.place("document", part, (part.get("pages") or 1) * PAGE_TOKENS)

    def visit_other(self, part: dict) -> None:
        self.place("other", part, 0)

    def place(self, kind: str, part: dict, tokens: int) -> None:
        i = self.first + len(self.attachments)
        self.out.append(f"<|{kind}:{i}|>")
        self.attachments.append({"index": i, "kind": kind, "ref": part.get("ref"), "tokens": tokens})


def turns(formatted: str) -> Iterator[tuple[str, int, int]]:
    """(role, start, end) of each turn: its role, and where its content lies, still escaped."""
    at = 0
    while at < len(formatted):
        head = _ROLE.match(formatted, at)
        if head is None:
            raise ValueError("no turn begins here")
        end = next((m for m in _END.finditer(formatted, head.end()) if m[0][0] != "\\"), None)
        if end is None:
            raise ValueError("turn does not end")
        yield unescape(head[1]), head.end(), end.start()
        at = end.end()


def parts(content: str) -> Iterator[tuple[str, str | int]]:
    """Parts of a flattened content: ("text", unescaped text) or (kind, attachment's number)."""
    at = 0
    for m in _PLACE.finditer(content):
        if m[1]:
            if m.start() > at:
                yield "text", unescape(content[at:m.start()])
            yield m[1], int(m[2])
            at = m.end()
    if at < len(content):
        yield "text", unescape(content[at:])


def text_of(content: str) -> str:
    """The texts of a flattened content, without its placeholders."""
    return "".join(v for kind, v in parts(content) if kind == "text") if "<|" in content else unescape(content)


_ATTACHMENT = "array<struct<index:int,kind:string,ref:string,tokens:long>>"


def format_chats(messages: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text",
                 loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """Chunks of formatted conversations: (key, part, n_turns, formatted, loss, attachments, media_tokens), written
    to the shared folder.  The chunks of a conversation in the order of ``part`` are its whole text; ``loss`` holds
    the spans (code points) of the escaped contents that count for the loss."""
    typed = isinstance(messages.schema[content].dataType, T.ArrayType)
    if typed:
        have = {f.name for f in messages.schema[content].dataType.elementType.fields}
        kinds = {"width": "double", "height": "double", "seconds": "double", "pages": "long"}
        body = F.transform(F.col(content), lambda p: F.when(p.isNotNull(), F.struct(*[
            (p[n] if n in have else F.lit(None)).cast(kinds.get(n, "string")).alias(n) for n in _PART_FIELDS])))
        tie = F.to_json(body)
    else:
        body = tie = F.coalesce(F.col(content).cast("string"), F.lit(""))
    rows = messages.select(F.col(key).alias("__key"), F.col(turn).alias("__turn"),
                           F.coalesce(F.col(role).cast("string"), F.lit("")).alias("__role"), body.alias("__body"),
                           tie.alias("__tie"))
    rows = rows.repartitionByRange("__key", "__turn", "__role").sortWithinPartitions("__key", "__turn", "__role", "__tie")
    rows = rows.withColumn("__at", F.spark_partition_id()).select("__key", "__role", "__body", "__at")
    kind = messages.schema[key].dataType
    schema = (f"`{key}` {kind.simpleString()}, part long, n_turns long, formatted string, "
              f"loss array<struct<start:long,end:long>>, attachments {_ATTACHMENT}, media_tokens long")
    trained = frozenset(loss_roles)

    def run(batches):
        names = [key, "part", "n_turns", "formatted", "loss", "attachments", "media_tokens"]
        types = [None, pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
                 pa.list_(pa.struct([("index", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])),
                 pa.int64()]
        now, n, size, out, loss, held, seq = None, 0, 0, [], [], [], 0
        done, waiting = [], 0

        def table():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)

        for b in batches:
            types[0] = b.schema.field(0).type
            for i in range(b.num_rows):
                k, r, x, at = (b.column(j)[i].as_py() for j in range(4))
                if n and (k != now or size >= CHUNK):
                    done.append((now, (at << 33) + seq, n, "".join(out), loss, held, sum(a["tokens"] for a in held)))
                    waiting, n, size, out, loss, held, seq = waiting + size, 0, 0, [], [], [], seq + 1
                    if waiting >= CHUNK:
                        yield table()
                        done, waiting = [], 0
                now = k
                head = f"### {escape(r, _CONTROL)}: "
                if typed:
                    flat = Flatten(len(held))
                    for p in x or ():
                        if p is not None:
                            flat.visit(p)
                    held += flat.attachments
                    x = "".join(flat.out)
                else:
                    x = escape(x)
                if r in trained:
                    loss.append({"start": size + len(head), "end": size + len(head) + len(x)})
                out += [head, x, "</turn>\n"]
                n, size = n + 1, size + len(head) + len(x) + 8
        if n:
            done.append((now, (at << 33) + seq, n, "".join(out), loss, held, sum(a["tokens"] for a in held)))
        if done:
            yield table()

    return materialize(W.map_batches(rows, run, schema))


def read_chats(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """The turns read back: (key, part, position, role, text, in_loss), placeholders left out of the texts."""
    kind = formatted.schema[key].dataType.simpleString()
    rows = formatted.select(F.col(key).alias("__key"), "part", "formatted", "loss")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                text = b.column(2)[i].as_py()
                spans = {(s["start"], s["end"]) for s in b.column(3)[i].as_py()}
                got = [(p, r, text_of(text[s:e]), (s, e) in spans) for p, (r, s, e) in enumerate(turns(text))]
                yield pa.RecordBatch.from_arrays([
                    pa.array([b.column(0)[i].as_py()] * len(got), b.schema.field(0).type),
                    pa.array([b.column(1)[i].as_py()] * len(got), pa.int64()), pa.array([g[0] for g in got], pa.int32()),
                    pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string()),
                    pa.array([g[3] for g in got], pa.bool_())], [key, "part", "position", "role", "text", "in_loss"])

    return W.map_batches(rows, run, f"`{key}` {kind}, part long, position int, role string, text string, in_loss boolean")


def digests(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """Per conversation, read back from its formatted chunks: (key, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, media_tokens).  ``turns_sha256`` is over role, line feed, text, line feed of every turn,
    ``loss_sha256`` over the unescaped contents of the loss spans."""
    kind = formatted.schema[key].dataType.simpleString()
    rows = formatted.select(F.col(key).alias("__key"), "part", "formatted", "loss", "media_tokens")
    several = rows.groupBy("__key").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    several = several.select(F.col("__key").alias("__several"))
    marked = rows.join(several, F.col("__key").eqNullSafe(F.col("__several")), "left_semi")
    alone = rows.join(several, F.col("__key").eqNullSafe(F.col("__several")), "left_anti")
    names = [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "media_tokens"]
    types = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        now, began = None, False
        for b in batches:
            done = []
            for i in range(b.num_rows):
                k, text, spans = b.column(0)[i].as_py(), b.column(2)[i].as_py(), b.column(3)[i].as_py()
                if not began or k != now:
                    if began:
                        done.append((now, n, seen.hexdigest(), chars, trained.hexdigest(), size, media))
                    now, began, n, chars, size, media = k, True, 0, 0, 0, 0
                    seen, trained = hashlib.sha256(), hashlib.sha256()
                for r, s, e in turns(text):
                    seen.update(f"{r}\n{text_of(text[s:e])}\n".encode())
                    n += 1
                for s in spans:
                    x = text_of(text[s["start"]:s["end"]])
                    trained.update(x.encode())
                    chars += len(x)
                size, media = size + len(text), media + b.column(4)[i].as_py()
            types[0] = b.schema.field(0).type
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)
        if began:
            last = (now, n, seen.hexdigest(), chars, trained.hexdigest(), size, media)
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(last, types)], names)

    schema = (f"`{key}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
              "formatted_chars long, media_tokens long")
    together = marked.repartition("__key").sortWithinPartitions("__key", "part")
    return W.map_batches(alone, run, schema).unionByName(W.map_batches(together, run, schema))
