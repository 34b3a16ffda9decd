"""Positions of regular-expression matches, and running values over arrays, in SQL expressions alone."""

from __future__ import annotations

from collections.abc import Callable

SPANS = "array<struct<start:int,end:int>>"
#: Elements of an array that are walked with one growing result; longer arrays are walked block by block, so that the work
#: stays in proportion to their length.
BLOCK = 256


def walk(items: str, zero: str, total: Callable[[str], str], combine: Callable[[str, str], str], inner: Callable[[str, str], str], block: int = BLOCK) -> str:
    """SQL for an array built by one pass over the array `items` with a value carried along, block by block.

    `total(b)` is what a block adds to the carried value, `combine(c, t)` the value after it, `inner(b, c)` the array that
    block b yields when it starts with the value c.
    """
    cut = f"transform(sequence(0, greatest(size(z_) - 1, 0) div {block}), k_ -> slice(z_, k_ * {block} + 1, {block}))"
    carried = f"aggregate(b_, array({zero}), (c_, x_) -> concat(c_, array({combine('element_at(c_, -1)', total('x_'))})))"
    return f"transform(array({items}), z_ -> transform(array({cut}), b_ -> flatten(zip_with(b_, slice({carried}, 1, size(b_)), (y_, v_) -> {inner('y_', 'v_')})))[0])[0]"


def placed_spans(pieces: str, hits: str, measure: str = "char_length({})", strip: str = "0") -> str:
    """SQL for array<struct<start, end>> (end exclusive) of `hits`, the matches between the `pieces` of a text split at them.

    Running sums of `measure` over pieces and matches are the positions. `strip` is added to every start.
    """
    size = measure.format
    step = lambda x: f"{size(x + '.pre')} + coalesce({size(x + '.hit')}, 0)"
    inner = f"""aggregate({{0}}, named_struct('at', {{1}}, 'spans', cast(array() AS {SPANS})),
        (a, x) -> named_struct(
            'at', a.at + {step("x")},
            'spans', if(x.hit IS NULL, a.spans, concat(a.spans, array(named_struct(
                'start', a.at + {size("x.pre")} + {strip}, 'end', a.at + {size("x.pre")} + {size("x.hit")}))))),
        a -> a.spans)"""
    return walk(
        f"zip_with({pieces}, {hits}, (p, h) -> named_struct('pre', p, 'hit', h))",
        "0",
        lambda b: f"aggregate({b}, 0, (s, x) -> s + {step('x')})",
        lambda c, t: f"{c} + {t}",
        inner.format,
    )


def match_spans(text: str, pattern: str, measure: str = "char_length({})", strip: str = "0") -> str:
    """SQL for the leftmost non-overlapping matches of `pattern` in `text`, as array<struct<start, end>>, end exclusive."""
    return placed_spans(f"split({text}, {pattern}, -1)", f"regexp_extract_all({text}, {pattern}, 0)", measure, strip)
