"""Conversation structure repair: cheapest edits that give legal role sequences, by weighted CYK over intervals of rows.

Legal are no rows, or an optional system row and then pairs of a user and an assistant row. Edits of a row: Keep (cost 0), Rerole to user or
assistant (2), Delete (3; a must for blank rows and for rows whose role and text stood earlier); an undeleted row whose text
does not end with ``.``, ``!`` or ``?`` adds 1; Insert puts an empty user or assistant row anywhere (2).

**Grammar**, in Chomsky normal form. A nonterminal (p, q) derives the rows that lead from place p to place q of a legal conversation (places: start, after
system, after user, after assistant): (p, q) -> (p, r) (r, q), and (p, q) -> row for each edit of one row. Insertions are derivations of no
row; each row's cells are closed under them on both sides once, and what is combined from closed cells is closed. A cell holds the smallest
(cost, audit), audit being the edits' initials. Two audits of one span with equal cost never continue each other (a further letter
would be an Insert and cost 2), so the smaller part always gives the smaller whole.

**Chart.** Spans of up to ``BLOCK`` rows are filled bottom-up by length over all splits. Since a legal path can be cut at any row, longer spans
need one split only: blocks are combined pairwise, by doubling length. Rows are sorted by range over the cluster, and a conversation is
a sequence of pieces of at most ``PIECE_ROWS`` rows, so a conversation with a third of all rows is charted by many tasks; its pieces'
cells meet in pairs, one round for each doubling. Only the digest of its repaired text runs through all of it, as a stream.

Defined results: rows are taken by turn (nulls first; ties by role, then text; equal rows are copies, all but one are duplicates); null role or text is one
space; a null conv_id is a conversation of its own. Other columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import content_key

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
LEADS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
LEGAL_PAIRS = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}
BLANKS = " \t\n\x0b\x0c\r"
BLOCK = 12
PIECE_ROWS, PIECE_BYTES = 2048, 4 << 20

Cells = dict[tuple[int, int], tuple[int, str]]


# --- cells and the chart --------------------------------------------------------------------------------

def combine(left: Cells, right: Cells) -> Cells:
    """(p, q) -> (p, r) (r, q)."""
    out: Cells = {}
    for (p, r), (cost, audit) in left.items():
        for (s, q), (more, rest) in right.items():
            if r == s:
                cell = (cost + more, audit + rest)
                if (p, q) not in out or cell < out[p, q]:
                    out[p, q] = cell
    return out


def least(a: Cells, b: Cells) -> Cells:
    return {k: min(c for c in (a.get(k), b.get(k)) if c is not None) for k in {**a, **b}}


def _insertions() -> Cells:
    """Derivations of no row: the cheapest insertions from place to place."""
    cells: Cells = {(p, p): (0, "") for p in range(4)}
    one = {(p, q): (INSERT, "I") for (p, c), q in LEADS.items() if c in ROLES}
    while (longer := least(cells, combine(cells, one))) != cells:
        cells = longer
    return cells


INSERTIONS = _insertions()


@lru_cache(maxsize=64)
def row_cells(symbol: str) -> Cells:
    """Closed cells of one row. symbol: ``d`` (must go), else its role's initial (``x`` for others), upper case if truncated."""
    cells: Cells = {(p, p): (DELETE, "D") for p in range(4)}
    if symbol != "d":
        extra = TRUNCATED * symbol.isupper()
        for (p, c), q in LEADS.items():
            edit = (KEEP + extra, "K") if c == symbol.lower() else (REROLE + extra, "R") if c in ROLES else None
            if edit:
                cells = least(cells, {(p, q): edit})
    return combine(combine(INSERTIONS, cells), INSERTIONS)


@lru_cache(maxsize=20_000)
def block_cells(symbols: str) -> Cells:
    """CYK over one block: every span by increasing length, over all its splits."""
    n = len(symbols)
    chart = {(i, i + 1): row_cells(symbols[i]) for i in range(n)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cells: Cells = {}
            for k in range(i + 1, i + length):
                cells = least(cells, combine(chart[i, k], chart[k, i + length]))
            chart[i, i + length] = cells
    return chart[0, n] if n else INSERTIONS


def span_cells(symbols: str) -> Cells:
    """Cells of a whole span: blocks, then pairs of neighbours by doubling length."""
    level = [block_cells(symbols[i:i + BLOCK]) for i in range(0, len(symbols), BLOCK)] or [INSERTIONS]
    while len(level) > 1:
        level = [combine(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def best(cells: Cells) -> tuple[int, str]:
    return min(cells[START, q] for q in ENDS if (START, q) in cells)


# --- rows, pieces, repaired rows -------------------------------------------------------------------------

class Repairer:
    """Reads an audit along the rows of its conversation, in as many calls as they come in."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.place, self.sha, self.first = audit, 0, START, hashlib.sha256(), True

    def _put(self, edit: str, role: str, text: str) -> dict:
        self.place = LEADS[self.place, role[0]]
        self.sha.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.first = False
        return {"edit": edit, "role": role, "text": text}

    def _next_role(self) -> str:
        return ROLES["a" if self.place == USER else "u"]

    def _inserts(self) -> Iterator[dict]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._put("I", self._next_role(), "")

    def feed(self, rows: list[dict]) -> Iterator[dict]:
        for row in rows:
            yield from self._inserts()
            edit = self.audit[self.at]
            self.at += 1
            if edit != "D":
                yield self._put(edit, row["role"] if edit == "K" else self._next_role(), row["text"])

    def end(self) -> Iterator[dict]:
        yield from self._inserts()


def _fault(role: str, text: str, again: bool) -> str:
    last = text.rstrip(BLANKS)[-1:]
    return "blank" if not last else "duplicate" if again else "truncated" if last not in ".!?" else ""


class Piece:
    """Neighbouring rows of one conversation, counted as they come."""

    def __init__(self, conv, seq: int) -> None:
        self.conv, self.seq, self.rows, self.symbols, self.bytes = conv, seq, [], [], 0
        self.sums = {"n": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "lo": None, "hi": None, "head": "", "tail": ""}

    def add(self, turn, role: str, text: str, again: bool) -> None:
        s, fault, initial = self.sums, _fault(role, text, again), role[:1]
        if s["n"]:
            s["illegal"] += s["tail"] + initial not in LEGAL_PAIRS
        else:
            s["head"] = initial
        s["tail"] = initial
        s["n"] += 1
        if fault:
            s[fault] += 1
        if turn is not None:
            s["turns"] += turn != s["hi"]
            s["lo"], s["hi"] = turn if s["lo"] is None else s["lo"], turn
        symbol = initial if initial in ("s", "u", "a") else "x"
        self.symbols.append("d" if fault in ("blank", "duplicate") else symbol.upper() if fault else symbol)
        self.rows.append({"role": role, "text": text})
        self.bytes += len(text)


def joined(a: dict, b: dict) -> dict:
    """Counts of two neighbouring pieces together."""
    met = a["hi"] is not None and a["hi"] == b["lo"]
    out = {k: a[k] + b[k] for k in ("n", "blank", "duplicate", "truncated", "illegal", "turns")}
    out["illegal"] += a["tail"] + b["head"] not in LEGAL_PAIRS
    out["turns"] -= met
    return out | {"lo": b["lo"] if a["lo"] is None else a["lo"], "hi": a["hi"] if b["hi"] is None else b["hi"], "head": a["head"], "tail": b["tail"]}


_SUMS = "n long, blank long, duplicate long, truncated long, illegal long, turns long, lo long, hi long, head string, tail string"
_CELLS = "array<struct<p:int,q:int,cost:long,audit:string>>"
_TURNS = "array<struct<edit:string,role:string,text:string>>"
_SUMMARY = f"conv_id {{conv}}, part int, seq int, {_SUMS}, cells {_CELLS}"


def _to_list(cells: Cells) -> list[dict]:
    return [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in sorted(cells.items())]


def _from_list(cells) -> Cells:
    return {(c["p"], c["q"]): (c["cost"], c["audit"]) for c in cells}


def _pieces(schema: pa.Schema):
    """Sorted rows -> pieces. A conversation that begins and ends inside the partition, in one piece, is repaired at once (``turns`` and
    ``sha``); the pieces of others carry their rows and cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[dict] = []
        piece: Piece | None = None
        seq = size = 0
        before = None
        alone = False  # the piece begins its conversation, and that began inside the partition

        def close(whole: bool) -> None:
            nonlocal size
            cells = span_cells("".join(piece.symbols))
            row = {"conv_id": piece.conv, "part": part, "seq": piece.seq, **piece.sums}
            if whole:
                cost, audit = best(cells)
                fixer = Repairer(audit)
                row |= {"repaired": [*fixer.feed(piece.rows), *fixer.end()], "cost": cost, "audit": audit, "sha": fixer.sha.hexdigest()}
            else:
                row |= {"cells": _to_list(cells), "rows": piece.rows}
            out.append(row)
            size += piece.bytes + 100 * len(piece.rows)

        for batch in batches:
            for conv, turn, role, text, again in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "again")), strict=True):
                copy = before == (conv, turn, role, text)
                before = (conv, turn, role, text)
                if piece is None or piece.conv != conv:
                    if piece is not None:
                        close(alone)
                    alone = piece is not None
                    piece = Piece(conv, seq)
                    seq += 1
                elif len(piece.rows) >= PIECE_ROWS or piece.bytes >= PIECE_BYTES:
                    close(False)
                    alone = False
                    piece = Piece(conv, seq)
                    seq += 1
                piece.add(turn, role, text, again or copy)
                if size >= PIECE_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
        if piece is not None:
            close(False)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _pair(pdf: pd.DataFrame) -> pd.DataFrame:
    """Two neighbouring pieces (or a last one without a partner) as one."""
    plain = lambda v: v if hasattr(v, "__len__") else None if pd.isna(v) else int(v)
    rows = [{k: plain(v) for k, v in r.items() if k != "conv_id"} for r in pdf.sort_values("at").to_dict("records")]
    sums, cells = rows[0], _from_list(rows[0]["cells"])
    for row in rows[1:]:
        sums, cells = joined(sums, row), combine(cells, _from_list(row["cells"]))
    out = pd.DataFrame([{**sums, "at": rows[0]["at"] // 2, "cells": _to_list(cells)}])
    out.insert(0, "conv_id", pdf["conv_id"].to_numpy()[:1])
    return out


def _finish(schema: pa.Schema):
    """Per conversation a row with the audit, then its pieces in order: repaired turns of each piece, then a row with the digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixer, conv = None, None

        def end() -> dict:
            return {"conv_id": conv, "part": None, "seq": None, "repaired": list(fixer.end()), "sha": fixer.sha.hexdigest()}

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["audit"] is not None:
                    if fixer:
                        out.append(end())
                    fixer, conv = Repairer(row["audit"]), row["conv_id"]
                else:
                    out.append({"conv_id": conv, "part": row["part"], "seq": row["seq"], "repaired": list(fixer.feed(row["rows"])), "sha": None})
            yield pa.RecordBatch.from_pylist(out, schema)
        if fixer:
            yield pa.RecordBatch.from_pylist([end()], schema)

    return run


@dataclass
class Repaired:
    """``report``: a row for each conversation with rows: conv_id, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of
    ``role:text`` lines). ``turns``: conv_id, part, seq and repaired (edit, role, text of each turn that is left); the conversation is its
    arrays by part and seq, nulls last."""

    report: DataFrame
    turns: DataFrame


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def repair(rows: DataFrame) -> Repaired:
    """rows: conv_id, turn, role, text."""
    spark, conv = rows.sparkSession, rows.schema["conv_id"].dataType.simpleString()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text")).withColumn("key", content_key(F.col("text")))
    # the first turn of each role and text: equal texts are counted together before they are dealt out
    nulls_first = F.struct(F.col("turn").isNotNull().alias("there"), F.col("turn").alias("turn"))
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("key").alias("k")).agg(F.min(nulls_first).alias("first"))
    same = rows["conv_id"].eqNullSafe(first["c"]) & (rows["role"] == first["r"]) & (rows["key"] == first["k"])
    flagged = rows.join(first, same).select("conv_id", "turn", "role", "text", (~F.col("first.turn").eqNullSafe(F.col("turn"))).alias("again"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role"]
    dealt = flagged.repartitionByRange(*order, F.substring("text", 1, 32)).sortWithinPartitions(*order, "text")
    ddl = (f"{_SUMMARY.format(conv=conv)}, rows array<struct<role:string,text:string>>, repaired {_TURNS}, cost long, audit string, sha string")
    pieces = cut_lineage(dealt.mapInArrow(_pieces(_arrow(spark, ddl)), ddl))

    parts = pieces.filter("sha IS NULL")
    w = Window.partitionBy("conv_id").orderBy("part", "seq")  # a row for each piece, without its texts
    sums = [x.split()[0] for x in _SUMS.split(", ")]
    left = cut_lineage(parts.select("conv_id", (F.row_number().over(w) - 1).cast("long").alias("at"), *sums, "cells"))
    while not left.filter("at > 0").isEmpty():
        left = cut_lineage(left.groupBy("conv_id", F.floor(F.col("at") / 2)).applyInPandas(_pair, left.schema))
    ends = F.filter("cells", lambda c: (c["p"] == START) & c["q"].isin(*ENDS))
    cell = F.array_min(F.transform(ends, lambda c: F.struct(c["cost"].alias("cost"), c["audit"].alias("audit"))))
    left = left.withColumn("best", cell)
    heads = left.select("conv_id", F.lit(-1).alias("part"), F.lit(-1).alias("seq"), F.col("best.audit").alias("audit"), F.lit(None).cast(parts.schema["rows"].dataType).alias("rows"))
    lines = heads.unionByName(parts.select("conv_id", "part", "seq", F.lit(None).cast("string").alias("audit"), "rows"))
    done = f"conv_id {conv}, part int, seq int, repaired {_TURNS}, sha string"
    streamed = cut_lineage(lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_finish(_arrow(spark, done)), done))

    digests = streamed.filter("sha IS NOT NULL").select(F.col("conv_id").alias("c"), "sha")
    counted = ["conv_id", F.col("n").alias("n_rows"), F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps"),
               "blank", "duplicate", "truncated", "illegal"]
    whole = pieces.filter("sha IS NOT NULL").select(*counted, "cost", "audit", F.col("sha").alias("repaired_sha256"))
    pieced = left.join(digests, left["conv_id"].eqNullSafe(digests["c"])).select(
        *counted, F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), F.col("sha").alias("repaired_sha256"))
    turns = pieces.filter("sha IS NOT NULL").select("conv_id", "part", "seq", "repaired").unionByName(streamed.select("conv_id", "part", "seq", "repaired"))
    return Repaired(whole.unionByName(pieced), turns)
