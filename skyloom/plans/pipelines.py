"""Pipelines: operators wired into one lazy plan.

A pipeline holds named steps, each a function from tables to tables, and gives a table for
every output. Outputs are lazy, but for blending and exact samples, which write or count.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.dust import A_OVER_EBV
from skyloom.operators import blending, errors, obscond, photometry, selections
from skyloom.sources.shared import materialize

Step = Callable[..., DataFrame]


@dataclass
class Pipeline:
    """Steps by name, each with the names of its inputs. ``input`` is the pipeline's own."""

    steps: dict[str, tuple[Step, tuple[str, ...]]] = field(default_factory=dict)

    def add(self, name: str, step: Step, *inputs: str) -> Pipeline:
        known = {"input", *self.steps}
        if name in known:
            raise ValueError(f"there is a step {name} already")
        if missing := [i for i in inputs if i not in known]:
            raise ValueError(f"step {name}: no input {', '.join(missing)}")
        self.steps[name] = (step, inputs)
        return self

    def run(self, table: DataFrame) -> dict[str, DataFrame]:
        made = {"input": table}
        for name, (step, inputs) in self.steps.items():
            made[name] = step(*[made[i] for i in inputs])
        del made["input"]
        return made

    def describe(self) -> str:
        """The wiring as JSON, by which two pipelines can be compared."""
        return json.dumps({name: list(inputs) for name, (_, inputs) in self.steps.items()}, indent=1)


@dataclass(frozen=True)
class ErrorModel:
    """A named error model of a pipeline: parameters, and sky conditions if they vary."""

    params: errors.ErrorParams
    conditions: obscond.ObsConditions | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        if self.conditions is None:
            return errors.add_errors(df, self.params)
        return obscond.with_conditions(df, replace(self.conditions, params=self.params))


@dataclass(frozen=True)
class PipelineConfig:
    dust: photometry.DustMap
    error_models: dict[str, ErrorModel]
    selectors: dict[str, selections.SpecConfig]
    blend: blending.BlendConfig | None = None
    parallel: bool = False
    #: With ``parallel``, the models whose results are selected from.
    models_to_select: tuple[str, ...] = ()


def _extinction(cfg: PipelineConfig, model: ErrorModel) -> photometry.DustMap:
    mags = {model.params.mag(b): A_OVER_EBV[b] for b in model.params.bands if b in A_OVER_EBV}
    return replace(cfg.dust, mags=mags, copy_all_cols=True)


def _dust(cfg: PipelineConfig) -> photometry.DustMap:
    return replace(cfg.dust, copy_all_cols=True)


def apply_phot_errors(cfg: PipelineConfig) -> Pipeline:
    """Redden; then each model on the one before and one dereddening, or with ``parallel`` each on the reddened table."""
    p = Pipeline().add("redden", lambda t: photometry.redden(t, _dust(cfg)), "input")
    before = "redden"
    for name, model in cfg.error_models.items():
        p.add(f"errors_{name}", model.apply, before)
        if cfg.parallel:
            p.add(f"deredden_{name}", lambda t, m=model: photometry.deredden(t, _extinction(cfg, m)), f"errors_{name}")
        else:
            before = f"errors_{name}"
    if not cfg.parallel:
        p.add("deredden", lambda t: photometry.deredden(t, _dust(cfg)), before)
    return p


def spectroscopic_selection(cfg: PipelineConfig) -> Pipeline:
    """Independent selectors, each on the input."""
    p = Pipeline()
    for name, c in cfg.selectors.items():
        p.add(f"select_{name}", lambda t, n=name, c=c: selections.select(t, n, c), "input")
    return p


def blend_catalog(cfg: PipelineConfig) -> Pipeline:
    """Merged blends, with the merged row's id."""
    own = cfg.blend or blending.BlendConfig()
    return Pipeline().add("blend", lambda t: _blended(t, own), "input")


def _blended(df: DataFrame, cfg: blending.BlendConfig) -> DataFrame:
    out = blending.unrecognized_blends(df, cfg)["output"]
    return out.withColumn(cfg.row_id, F.col("group_id"))


def truth_to_observed(cfg: PipelineConfig) -> Pipeline:
    """Redden, blend, add errors, deredden and select.

    In series, models follow one another and all selectors read the last result. With
    ``parallel``, each model reads the reddened (and, if blended, merged) table and is
    dereddened on its own; selectors read the models named in ``models_to_select``.
    """
    p = Pipeline().add("redden", lambda t: photometry.redden(t, _dust(cfg)), "input")
    base = "redden"
    if cfg.blend is not None:
        p.add("blend", lambda t: _blended(t, cfg.blend), base)
        base = "blend"
    before, last = base, None
    for name, model in cfg.error_models.items():
        p.add(f"errors_{name}", model.apply, before)
        last = name
        if cfg.parallel:
            chosen = name in cfg.models_to_select
            p.add(
                f"deredden_{name}",
                lambda t, m=model, c=chosen: (lambda d: _shared(d, cfg) if c else d)(photometry.deredden(t, _extinction(cfg, m))),
                f"errors_{name}",
            )
            if chosen:
                _add_selectors(p, cfg, name, f"deredden_{name}")
        else:
            before = f"errors_{name}"
    if not cfg.parallel:
        p.add("deredden", lambda t: _shared(photometry.deredden(t, _dust(cfg)), cfg), before)
        _add_selectors(p, cfg, last or "truth", "deredden")
    return p


def _shared(df: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """What selectors read is written once: none makes the noise again, and their cuts are pushed into a scan."""
    return materialize(df, "observed") if cfg.selectors else df


def _add_selectors(p: Pipeline, cfg: PipelineConfig, model: str, source: str) -> None:
    for name, c in cfg.selectors.items():
        p.add(f"select_{name}_{model}", lambda t, n=name, c=c: selections.select(t, n, c), source)
