"""Match positions, span merging and masked snippets inside one row.

Offsets are 0-based code points, half-open, as Spark's ``length`` and
``substring`` count them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse_whitespace, let, redact

SNIPPET_MARGIN = 50

SPAN = "struct<s:int,e:int>"

#: Characters of a piece of a long text.  Finding a place in a text costs its distance from the beginning.
PIECE = 512


def cut(text: Column, start: Column, end: Column) -> Column:
    """``text[start:end]``."""
    return F.substring(text, start + 1, end - start)


def pieces(text: Column, size: Column) -> Column:
    """*text* of *size* characters in pieces of :data:`PIECE`, in which :func:`cut_pieces` finds places at once."""
    return F.when(size <= PIECE, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0)))


def cut_pieces(parts: Column, start: Column, end: Column) -> Column:
    """``text[start:end]`` of a text in :func:`pieces`; *start* lies inside of it."""
    first, last = _piece(start), _piece(F.greatest(end - 1, start))
    held = F.when(first == last, F.get(parts, first)).otherwise(
        F.array_join(F.slice(parts, first + 1, last - first + 1), ""))
    return F.substring(held, start - first * PIECE + 1, end - start)


def _piece(at: Column) -> Column:
    return F.shiftright(at, PIECE.bit_length() - 1)


def window(parts: Column, start: Column, end: Column, margin: Column) -> Column:
    """The text from *margin* before *start* to *margin* after *end*, of a text in :func:`pieces`."""
    return cut_pieces(parts, F.greatest(start - margin, F.lit(0)), end + margin)


#: Matches whose places are added up in one go; each step of a fold copies what it has gathered.
_BLOCK = 32


def _positions(count: Column, gap, match) -> Column:
    """Spans of *count* matches, given the text before the i-th and the i-th."""
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, i: Column) -> Column:
        s = acc["at"] + F.length(gap(i))
        e = s + F.length(match(i))
        return F.struct(
            e.alias("at"),
            F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e")))).alias("out"),
        )

    def spans(numbers: Column, at: Column) -> Column:
        return F.aggregate(numbers, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def in_blocks(blocks: Column) -> Column:
        lengths = F.transform(blocks, lambda block: F.aggregate(
            block, F.lit(0), lambda n, i: n + F.length(gap(i)) + F.length(match(i))))
        ends = F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return let(ends, lambda starts: F.flatten(F.transform(blocks, lambda block, b: spans(block, starts[b]))))

    firsts = F.sequence(F.lit(0), count - 1, F.lit(_BLOCK))
    blocks = F.transform(firsts, lambda i: F.sequence(i, F.least(i + _BLOCK, count) - 1))
    return F.when(count <= _BLOCK, spans(F.sequence(F.lit(0), count - 1), F.lit(0))).otherwise(let(blocks, in_blocks))


def match_positions(matches: Column, gaps: Column) -> Column:
    """Start and end of each match, from the matches and the text between them."""
    return _positions(F.size(matches), lambda i: gaps[i], lambda i: matches[i])


def marked_positions(parts: Column) -> Column:
    """The same from a text split at marks: gap, match, two groups, gap, ..."""
    count = F.floor((F.size(parts) - 1) / 4).cast("int")
    return _positions(count, lambda i: parts[i * 4], lambda i: parts[i * 4 + 1])


def merge_spans(spans: Column) -> Column:
    """Union of half-open spans; spans that touch become one."""
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, span: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1),
            F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], span["e"]).alias("e"))),
        )
        return F.when(span["s"] <= last["e"], joined).otherwise(F.concat(acc, F.array(span)))

    return F.aggregate(F.array_sort(spans), none, step)


def masked_spans(parts: Column, spans: Column, size: Column) -> Column:
    """*spans*, merged and in order, with what may be shown of each: those near each piece of a text, in an array for each."""
    with_mask = F.transform(spans, lambda x: F.struct(
        x["s"].alias("s"), x["e"].alias("e"), redact(cut_pieces(parts, x["s"], x["e"])).alias("mask")))

    def near(all_spans: Column) -> Column:
        return F.when(size <= PIECE, F.array(all_spans)).otherwise(F.transform(
            F.sequence(F.lit(0), _piece(size - 1)),
            lambda p: F.filter(all_spans, lambda x: (x["s"] < (p + 2) * PIECE) & (x["e"] > p * PIECE))))

    return let(with_mask, near)


def snippet(parts: Column, near_pieces: Column, size: Column, start: Column, end: Column) -> Column:
    """The neighbourhood of a match with every detected span masked, from a text's pieces and :func:`masked_spans`.

    A span cut by the edge of the neighbourhood shows nothing at all.
    """
    bounds = F.struct(
        F.greatest(start - SNIPPET_MARGIN, F.lit(0)).alias("left"), F.least(end + SNIPPET_MARGIN, size).alias("right"))

    def render(w: Column) -> Column:
        width = w["right"] - w["left"]
        first, last = _piece(w["left"]), _piece(w["right"] - 1)
        # a piece knows the spans up to the end of the next one; of those after it only what is new is taken
        around = F.when(last <= first + 1, F.get(near_pieces, first)).otherwise(F.flatten(F.transform(
            F.sequence(first, last),
            lambda p: F.filter(F.get(near_pieces, p), lambda x: (p == first) | (x["s"] >= (p + 1) * PIECE)))))
        near = F.filter(around, lambda x: (x["e"] > w["left"]) & (x["s"] < w["right"]))

        def step(acc: Column, x: Column) -> Column:
            s, e = x["s"] - w["left"], x["e"] - w["left"]
            shown = F.greatest(s, F.lit(0))
            whole = (s >= 0) & (e <= width)
            return F.struct(
                F.greatest(acc["at"], F.least(e, width)).alias("at"),
                F.concat(
                    acc["out"],
                    F.when(shown > acc["at"], cut(w["text"], acc["at"], shown)).otherwise(""),
                    F.when(whole, x["mask"]).otherwise("***"),
                ).alias("out"),
            )

        masked = F.aggregate(
            near,
            F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
            step,
            lambda acc: F.concat(
                acc["out"],
                F.when(acc["at"] < width, cut(w["text"], acc["at"], width)).otherwise(""),
            ),
        )
        return F.concat(
            F.when(w["left"] > 0, "…").otherwise(""),
            F.trim(collapse_whitespace(masked)),
            F.when(w["right"] < size, "…").otherwise(""),
        )

    return let(bounds, lambda b: let(
        F.struct(b["left"].alias("left"), b["right"].alias("right"), cut_pieces(parts, b["left"], b["right"]).alias("text")), render))
