"""Operators made of operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.columns import c, hidden
from ..core.condition import HasPrefix
from ..core.pipe import Pipe
from .report import PrintBatch


class PipeProcessError(Exception):
    """What went wrong in a pipe of a pipeline, with the pipe and the columns that it saw."""

    def __init__(self, pipe: Pipe, df: DataFrame, cause: Exception):
        self.pipe, self.cause = pipe, cause
        super().__init__(f"{type(pipe).__name__} over {df.columns}: {type(cause).__name__}: {cause}")

    @staticmethod
    def run(pipe: Pipe, df: DataFrame, carry, **kwargs) -> DataFrame:
        """Wraps once: an error that already names its pipe is passed on."""
        try:
            return pipe.transform(df, carry, **kwargs)
        except PipeProcessError:
            raise
        except Exception as e:
            raise PipeProcessError(pipe, df, e) from e


class Pipeline(Pipe):
    """Base of pipelines."""


class Sequential(Pipeline):
    """One pipe after another; None is skipped."""

    def __init__(self, *pipes: Pipe | None, **kwargs):
        super().__init__(**kwargs)
        self.pipes = [x for x in pipes if x is not None]

    row_wise = property(lambda self: all(x.row_wise for x in self.pipes))

    def _exprs(self, cols, kinds, **kwargs):
        for pipe in self.pipes:
            cols, kinds = pipe.exprs(cols, kinds, **kwargs), pipe.kinds(kinds, **kwargs)
        return cols

    def _apply(self, df, carry, **kwargs):
        for pipe in self.pipes:
            df = PipeProcessError.run(pipe, df, carry, **kwargs)
        return df


class Parallel(Pipeline):
    """Each pipe sees the input; their outputs stand side by side, in one narrow stage if the pipes are narrow.

    A column that several give has to be equal in all: a row where it isn't fails when it is computed. Pipes that
    change the number of rows can't be put side by side: the rows of each would be multiplied.
    """

    def __init__(self, *pipes: Pipe | None, **kwargs):
        super().__init__(**kwargs)
        self.pipes = [x for x in pipes if x is not None]

    row_wise = property(lambda self: all(x.row_wise for x in self.pipes))

    @staticmethod
    def _agreed(outputs: list[dict[str, Column]]) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for made in outputs:
            for x, v in made.items():
                said = F.raise_error(F.lit(f"Parallel: pipes give different values of {x}"))
                out[x] = F.when(out[x].eqNullSafe(v), out[x]).otherwise(said) if x in out else v
        return out

    def _exprs(self, cols, kinds, **kwargs):
        return self._agreed([pipe.exprs(cols, kinds, **kwargs) for pipe in self.pipes])

    def _apply(self, df, carry, **kwargs):
        names = [x for x in df.columns if x not in carry]
        kept = hidden(len(names))
        df = df.select(*map(c, carry), *(c(x).alias(k) for x, k in zip(names, kept)))
        outputs: list[dict[str, str]] = []
        for pipe in self.pipes:
            held = [*carry, *kept, *(h for out in outputs for h in out.values())]
            seen = df.select(*map(c, held), *(c(k).alias(x) for x, k in zip(names, kept)))
            df = PipeProcessError.run(pipe, seen, held, **kwargs)
            made = [x for x in df.columns if x not in held]
            outputs.append(dict(zip(made, hidden(len(made)))))
            df = df.select(*map(c, held), *(c(x).alias(h) for x, h in outputs[-1].items()))
        out = self._agreed([{x: c(h) for x, h in made.items()} for made in outputs])
        return df.select(*map(c, carry), *(v.alias(x) for x, v in out.items()))


class ParallelbyField(Parallel):
    """A pipe for each field; it sees the columns ``field.*`` alone."""

    def __init__(self, pipes: Mapping[str, Pipe], **kwargs):
        super().__init__(*(Sequential(pipe, input_filter=HasPrefix(f"{field}.")) for field, pipe in pipes.items()), **kwargs)


class Gate(Pipeline):
    """A pipe if a condition holds, a truth value or a function of the table decided when the plan is made, else alt.

    Without the pipe that is chosen there are no columns (with update: the input's).
    """

    def __init__(self, condition: bool | Callable, pipe: Pipe | None, alt: Pipe | None = None, **kwargs):
        super().__init__(**kwargs)
        self.condition, self.pipe, self.alt = condition, pipe, alt

    def _apply(self, df, carry, **kwargs):
        names = [x for x in df.columns if x not in carry]
        on = self.condition(df.select(*map(c, names))) if callable(self.condition) else self.condition
        chosen = self.pipe if on else self.alt
        return PipeProcessError.run(chosen, df, carry, **kwargs) if chosen is not None else df.select(*map(c, carry))


class BlockSequential(Sequential):
    """A Sequential of (name, pipe) blocks; pprint prints what goes into and comes out of each."""

    def __init__(self, pipes: list[tuple[str, Pipe | None]], pprint: bool = False, **kwargs):
        blocks = [(name, pipe) for name, pipe in pipes if pipe is not None]
        self.names = [name for name, _ in blocks]
        parts = [x for name, pipe in blocks for x in ([PrintBatch(f"{name}::input"), pipe, PrintBatch(f"{name}::output")] if pprint else [pipe])]
        super().__init__(*parts, **kwargs)
