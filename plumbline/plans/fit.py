"""Robust low-rank fits: alternating reweighted least squares, one pass over the objects a cycle.

The rows stay where they are. The driver holds the basis of every model (features x K) and sends
it out; a task updates the coefficients of its objects and adds up the normal sums of the next
basis; Spark brings the sums of a feature together and solves its system there. Any number of models, of several ranks and losses and on several
groups of objects, share each pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions import kernels
from plumbline.functions.losses import Gaussian, Loss, StudentT
from plumbline.plans import rotate, start
from plumbline.plans.passes import Passes, Sums

CONV = ("max_frac_G", "max_frac_A", "rel_frac_loss", "none")
INIT = ("svd", "random", "custom")
ROTATION = ("fast", "slow", "identity")
# Basis sums of the models that share a pass; more models take turns.
WAVE_BYTES = 64 << 20
# Largest basis that the driver takes and sends out.
BASIS_BYTES = 512 << 20
# Most cycles in a row that do not write their coefficients, and the most that a task may do to go through such cycles again,
# counted in numbers of normal sums: about a quarter of a second.
AGAIN_CYCLES = 20
AGAIN_WORK = 16 << 20


@dataclass(frozen=True)
class ModelSpec:
    """One model of a joint fit: its rank and loss, and the group of objects it is fitted to."""

    model_id: str
    k: int
    loss: Loss
    grp: int = 0


@dataclass(frozen=True)
class Check:
    """What a stopping rule of one's own sees at a check: the cycles done, the basis now and at the check before, and the
    losses known by then (that of the cycle just done is not yet among them)."""

    n_iter: int
    g: np.ndarray
    seen_g: np.ndarray
    losses: tuple[float, ...]


@dataclass(frozen=True)
class Settings:
    # a name, or a function of (objects, k) that gives (G, coefficients); without coefficients (None) the weights give them
    init: str | Callable = "svd"
    # a name, or a function that is given a Check and tells whether the fit has settled
    conv: str | Callable = "max_frac_G"
    tol: float = 1e-3
    max_iter: int = 1000
    check_every: int = 10
    rotation: str = "fast"
    target: str = "G"
    whiten: bool = True
    eps: float = 1e-6
    ridge: float | None = None
    # "once" a cycle, or "each": again between the two half steps
    reweight: str = "once"
    # finish with an orthonormal basis ordered by singular value
    order: bool = False
    seed: int = 0

    def __post_init__(self):
        for name, allowed in (("init", INIT), ("conv", CONV), ("rotation", ROTATION), ("reweight", ("once", "each")), ("target", ("A", "G", "none"))):
            if callable(getattr(self, name)) and name in ("init", "conv"):
                continue
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}, got {getattr(self, name)!r}")
        if self.ridge is not None and self.ridge < 0:
            raise ValueError(f"ridge must not be negative, got {self.ridge}")
        if self.max_iter < 1 or self.check_every < 1:
            raise ValueError("max_iter and check_every must be at least 1")


@dataclass
class FittedModel:
    """A basis with what belongs to it. Coefficients of the training objects are a DataFrame."""

    spark: SparkSession
    spec: ModelSpec
    g: np.ndarray
    coeffs: DataFrame | None = None
    loss_history: list[float] = field(default_factory=list)
    n_iter: int = 0
    converged: bool = False
    ridge: float | None = None
    # the training objects with their coefficients, joined without a shuffle
    training: DataFrame | None = None
    # where the coefficients lie: the table shared by the models of a wave, and their columns in it
    slot: "tuple[DataFrame, Column] | None" = None
    # entries that are NaN after each cycle, in A, in G and in the robust weights
    nan_history: list[tuple[int, int, int]] = field(default_factory=list)

    @property
    def model_id(self) -> str:
        return self.spec.model_id

    @property
    def k(self) -> int:
        return self.spec.k

    @property
    def loss(self) -> Loss:
        return self.spec.loss

    @property
    def basis(self) -> DataFrame:
        rows = [(j, [float(x) for x in row]) for j, row in enumerate(self.g)]
        return self.spark.createDataFrame(rows, "feat_id int, g array<double>")

    @property
    def history(self) -> DataFrame:
        rows = [(self.model_id, i, float(x)) for i, x in enumerate(self.loss_history)]
        return self.spark.createDataFrame(rows, "model_id string, iter int, loss double")

    @property
    def nan_counts(self) -> DataFrame:
        """Entries of the coefficients, the basis and the robust weights that a cycle left NaN. A fit stops at the first."""
        rows = [(self.model_id, i, *counts) for i, counts in enumerate(self.nan_history)]
        return self.spark.createDataFrame(rows, "model_id string, iter int, nan_a bigint, nan_g bigint, nan_w bigint")

    def with_coeffs(self, coeffs: DataFrame) -> "FittedModel":
        return replace(self, coeffs=coeffs, training=None, slot=None)

    def infer(self, objects: DataFrame, **options) -> DataFrame:
        """Coefficients of any objects with this basis held fixed."""
        from plumbline.plans.score import infer

        return infer(objects, self, **options)

    def score(self, objects: DataFrame, **options) -> DataFrame:
        from plumbline.plans.score import score

        return score(objects, self, **options)

    def apply(self, objects: DataFrame | None = None, coeffs: DataFrame | None = None) -> DataFrame:
        """Objects with their reconstruction, residuals and robust weights as arrays.

        By default the training objects, which lie next to their coefficients; other objects are
        joined to the coefficients given. For objects without coefficients use ``score``.
        """
        from plumbline.plans.score import apply

        if objects is None:
            if self.training is None:
                raise ValueError("this model has no training objects")
            return apply(self.training, self)
        return apply(objects.join(coeffs if coeffs is not None else self.coeffs, "obj_id"), self)


@dataclass
class _Turn:
    """Driver-side state of one model, and what a pass is told about it."""

    spec: ModelSpec
    number: int
    offset: int
    g: np.ndarray
    start: np.ndarray | None = None
    t: np.ndarray = None
    live: bool = True
    converged: bool = False
    n_iter: int = 0
    from_seen: bool = False
    gram_a: np.ndarray | None = None
    seen_g: np.ndarray | None = None
    seen_loss: float = np.inf
    losses: list[float] = field(default_factory=list)
    bad: list[tuple[int, int, int]] = field(default_factory=list)
    size: float = 0.0

    def __post_init__(self):
        self.t = np.eye(self.spec.k)
        self.seen_g = self.g

    # numbers of this model's sum matrices
    @property
    def normal(self) -> int:
        return 3 * self.number

    @property
    def gram(self) -> int:
        return 3 * self.number + 1

    @property
    def scalars(self) -> int:
        return 3 * self.number + 2

    def told(self) -> dict:
        return {
            "grp": self.spec.grp, "k": self.spec.k, "loss": self.spec.loss, "at": self.offset, "g": self.g, "t": self.t,
            "start": self.start, "live": self.live, "from_seen": self.from_seen,
            "normal": self.normal, "gram": self.gram, "scalars": self.scalars,
        }


def _read(block: pa.RecordBatch):
    grp = block.column("grp").to_numpy()
    y, w = kernels.matrix(block.column("y")), kernels.matrix(block.column("w"))
    state = kernels.matrix(block.column("state")) if "state" in block.schema.names else None
    return grp, y, w, state


def _cycle(cells, state, turns: list[dict], width: int, settings: Settings, note: bool, sums: Sums | None = None, compare: bool = False) -> np.ndarray:
    """The state of a block's objects after one cycle. ``note``: remember these coefficients for the next comparison;
    ``compare``: measure how far they moved from the ones remembered before. Without ``sums`` only the state is wanted."""
    grp, y_all, w_all = cells
    ridge, each = settings.ridge, settings.reweight == "each"
    remember = settings.conv in ("max_frac_A", "rel_frac_loss")
    out = np.zeros((len(grp), width * (2 if remember else 1)))
    for m in turns:
        rows = grp == m["grp"]
        if not rows.any():
            continue
        own, mark = slice(m["at"], m["at"] + m["k"]), slice(width + m["at"], width + m["at"] + m["k"])
        if not m["live"]:
            out[rows, own] = state[rows, own]
            if remember:
                out[rows, mark] = state[rows, mark]
            continue
        y, w, g, loss = y_all[rows], w_all[rows], m["g"], m["loss"]
        if m["start"] is not None:
            a = y @ m["start"]
        elif state is None:
            a = kernels.a_step(y, w, g, ridge)
        else:
            a = state[rows, own] @ m["t"]
        r = y - a @ g.T
        if sums is not None:
            before = loss.loss_np(w, r).sum(), (a * a).sum(), a.size
        if remember:
            out[rows, mark] = a if note else state[rows, mark]
            if compare and sums is not None:
                sums.top(m["scalars"], float(((a - state[rows, mark]) ** 2).max()))
        wt = w * loss.weight_np(w, r)
        a = kernels.a_step(y, wt, g, ridge)
        out[rows, own] = a
        if sums is None:
            continue
        if each:
            r = y - a @ g.T
            wt = w * loss.weight_np(w, r)
        sums.add(m["scalars"], np.array([[*before, np.isnan(a).sum(), np.isnan(wt).sum()]]))
        sums.add(m["normal"], kernels.g_sums(y, wt, a))
        sums.add(m["gram"], a.T @ a)
    return out


def _als_step(told, width: int, settings: Settings, compare: bool, keep: bool):
    """Kernel of one cycle, the last of those ``told``. The ones before it are gone through again from the coefficients
    that were written last. Without ``keep`` only the sums are made."""

    def step(block: pa.RecordBatch, sums: Sums) -> np.ndarray | None:
        *cells, state = _read(block)
        *before, (turns, note) = told.value
        for past, noted in before:
            state = _cycle(cells, state, past, width, settings, noted)
        state = _cycle(cells, state, turns, width, settings, note, sums, compare)
        return state if keep else None

    return step


def _finish_step(turns, width: int, unwritten=None, settings: Settings | None = None):
    """Final coefficients in their final gauge, the number of valid cells, and the final loss.

    ``check`` is the gauge in which a last comparison with the remembered coefficients is due. ``unwritten`` are the cycles
    since the coefficients were last written.
    """

    def step(block: pa.RecordBatch, sums: Sums) -> np.ndarray:
        grp, y_all, w_all, state = _read(block)
        for past, noted in unwritten.value if unwritten is not None else ():
            state = _cycle((grp, y_all, w_all), state, past, width, settings, noted)
        out = np.zeros((len(grp), width + 1))
        out[:, width] = (w_all > 0).sum(axis=1)
        for m in turns.value:
            rows = grp == m["grp"]
            if not rows.any():
                continue
            at = m["at"] + (width if m["from_seen"] else 0)
            raw = state[rows, at : at + m["k"]]
            a = raw @ m["t"]
            if m.get("check") is not None:
                seen = state[rows, width + m["at"] : width + m["at"] + m["k"]]
                sums.top(m["scalars"], float(((raw @ m["check"] - seen) ** 2).max()))
            y, w = y_all[rows], w_all[rows]
            sums.add(m["scalars"], np.array([[m["loss"].loss_np(w, y - a @ m["g"].T).sum(), (a * a).sum(), a.size]]))
            out[rows, m["at"] : m["at"] + m["k"]] = a
        return out

    return step


def _writes(passes: Passes, live: list[_Turn], shapes: dict[int, tuple[int, int]], pending: int) -> bool:
    """Whether a cycle writes its coefficients. Writing costs much the same however few they are; going through the ``pending``
    cycles again costs as much as the objects ask for. A small fit writes seldom, a large one every cycle."""
    work = passes.n_objects * passes.width * sum(t.spec.k * (t.spec.k + 3) // 2 for t in live) // passes.tasks()
    return pending >= AGAIN_CYCLES or pending * work > AGAIN_WORK or not passes.holds(shapes)


def fit_many(
    objects: DataFrame,
    specs: list[ModelSpec],
    settings: Settings = Settings(),
    init: dict[str, tuple[np.ndarray, DataFrame | None]] | None = None,
    buckets: int | None = None,
    ready: bool = False,
) -> dict[str, FittedModel]:
    """Fit several models at once to ``objects(grp, obj_id, y, w)``.

    ``init`` gives a model its own start, (G, coefficients); without coefficients they come from
    the data weights. ``(grp, obj_id)`` must be unique. Objects that are ``ready``, bucketed by
    the two keys in as many buckets, are not copied.
    """
    if not specs:
        return {}
    settings, init = _own_start(objects, specs, settings, init)
    passes = Passes(objects, ["y", "w"], buckets, ready)
    m = passes.width
    for s in specs:
        if not 1 <= s.k <= min(passes.n_objects, m):
            raise ValueError(f"rank {s.k} of {s.model_id} is outside 1 .. {min(passes.n_objects, m)}")
        if 8 * m * s.k > BASIS_BYTES:
            raise ValueError(f"the basis of {s.model_id} has {8 * m * s.k >> 20} MB, more than the driver takes")
    waves: list[list[ModelSpec]] = [[]]
    size = 0
    for s in specs:
        cost = 8 * m * (s.k * (s.k + 3) // 2)
        if waves[-1] and size + cost > WAVE_BYTES:
            waves.append([])
            size = 0
        waves[-1].append(s)
        size += cost
    out: dict[str, FittedModel] = {}
    for wave in waves:
        out.update(_fit_wave(passes, wave, settings, init or {}))
    return out


def _offsets(specs: list[ModelSpec]) -> tuple[list[int], int]:
    used: dict[int, int] = {}
    offsets = []
    for s in specs:
        offsets.append(used.get(s.grp, 0))
        used[s.grp] = offsets[-1] + s.k
    return offsets, max(used.values())


def _pad(vec: Column, width: int) -> Column:
    return F.slice(F.concat(vec, F.array_repeat(F.lit(0.0), width)), 1, width)


def _first_rows(passes: Passes, turns: list[_Turn], width: int, settings: Settings, init: dict) -> DataFrame:
    """What the first pass reads: objects with starting coefficients, where these are not computed in the pass."""
    if settings.init == "random":
        by_group: dict[int, list[Column]] = {}
        for t in turns:
            by_group.setdefault(t.spec.grp, []).append(start.random_coeffs(F.col("obj_id"), settings.seed, t.spec.k))
        state = F.array().cast("array<double>")
        for grp, parts in by_group.items():
            state = F.when(F.col("grp") == grp, F.concat(*parts)).otherwise(state)
        return passes.objects.withColumn("state", _pad(state, width))
    if settings.init == "custom" and len(turns) == 1:
        coeffs = init[turns[0].spec.model_id][1]
        if coeffs is not None:
            given = coeffs.select("obj_id", F.lit(turns[0].spec.grp).cast("int").alias("grp"), _pad(F.col("a"), width).alias("state"))
            return passes.objects.join(given, ["grp", "obj_id"])
    return passes.objects


def _start(passes: Passes, specs: list[ModelSpec], settings: Settings, init: dict) -> list[_Turn]:
    offsets, _ = _offsets(specs)
    m = passes.width
    turns = []
    svd = {}
    if settings.init == "svd":
        ranks: dict[int, int] = {}
        for s in specs:
            ranks[s.grp] = max(ranks.get(s.grp, 0), s.k)
        svd = start.top_singular(passes, ranks)
    for i, (s, offset) in enumerate(zip(specs, offsets)):
        proj = None
        if settings.init == "svd":
            values, v = svd[s.grp]
            root = np.sqrt(values[: s.k])
            g = v[:, : s.k] * root
            proj = np.divide(v[:, : s.k], root, out=np.zeros((m, s.k)), where=root > 0)
        elif settings.init == "random":
            feats = passes.spark.range(m).select(F.col("id").cast("int").alias("feat_id"))
            rows = start.random_basis(feats, settings.seed, s.k).collect()
            g = np.array([r["g"] for r in sorted(rows, key=lambda r: r["feat_id"])])
        else:
            if s.model_id not in init:
                raise ValueError(f"a custom start needs a basis for {s.model_id}")
            g, coeffs = init[s.model_id]
            if g.shape != (m, s.k):
                raise ValueError(f"the basis of {s.model_id} has shape {g.shape}, not {(m, s.k)}")
            if coeffs is not None:
                if len(specs) > 1:
                    raise ValueError("starting coefficients can be given to a fit of one model only")
                _check_coeffs(coeffs, passes.n_objects, s.k)
        turns.append(_Turn(s, i, offset, np.asarray(g, float), proj))
    return turns


def _check_coeffs(coeffs: DataFrame, n: int, k: int) -> None:
    got = coeffs.agg(F.count_distinct("obj_id").alias("n"), F.min(F.size("a")).alias("lo"), F.max(F.size("a")).alias("hi")).first()
    if (got["n"], got["lo"], got["hi"]) != (n, k, k):
        raise ValueError(f"starting coefficients cover {got['n']} objects with rank {got['lo']} to {got['hi']}, not {n} with rank {k}")


def _rotation(settings: Settings, gram_a: np.ndarray, gram_g: np.ndarray):
    if settings.rotation == "identity":
        return rotate.identity(len(gram_a))
    if settings.rotation == "slow":
        return rotate.principal(gram_a, gram_g)
    return rotate.whiten(gram_a, gram_g, settings.target, settings.whiten, settings.eps)


def frac_change(old: np.ndarray, new: np.ndarray) -> float:
    """Largest squared change over the mean square. The tolerance it is held to bounds a squared ratio."""
    return float(((old - new) ** 2).max() / (new * new).mean())


def stops(settings: Settings, n_iter: int, g: np.ndarray, seen_g: np.ndarray, losses: list[float]) -> bool:
    """Whether a rule that looks at the basis, or one of the user's own, ends a fit at a check."""
    if callable(settings.conv):
        return bool(settings.conv(Check(n_iter, g, seen_g, tuple(losses))))
    return settings.conv == "max_frac_G" and frac_change(seen_g, g) < settings.tol


def _own_start(objects: DataFrame, specs: list[ModelSpec], settings: Settings, init: dict | None) -> tuple[Settings, dict | None]:
    """Let a start of the user's own make the basis of every model, from the objects of its group."""
    if not callable(settings.init):
        return settings, init
    made = {s.model_id: settings.init(objects.filter(F.col("grp") == s.grp), s.k) for s in specs}
    return replace(settings, init="custom"), made


def _fit_wave(passes: Passes, specs: list[ModelSpec], settings: Settings, init: dict) -> dict[str, FittedModel]:
    sc = passes.spark.sparkContext
    turns = _start(passes, specs, settings, init)
    _, width = _offsets(specs)
    later = settings.conv in ("max_frac_A", "rel_frac_loss")
    passes.state = None
    rows = _first_rows(passes, turns, width, settings, init)
    # the cycles since the coefficients were last written
    pending: list[tuple[list[dict], bool]] = []

    def is_check(i: int) -> bool:
        return i > 0 and i % settings.check_every == 0

    for i in range(settings.max_iter):
        live = [t for t in turns if t.live]
        shapes = {}
        for t in live:
            k = t.spec.k
            shapes.update({t.normal: (passes.width, k * (k + 3) // 2), t.gram: (k, k), t.scalars: (1, 5)})
        # Coefficients in hand are those after cycle i - 1; they are compared and remembered if that was a check.
        pending.append(([t.told() for t in turns], i == 0 or is_check(i - 1)))
        keep = i == 0 or _writes(passes, live, shapes, len(pending))
        told = sc.broadcast(pending)
        step = _als_step(told, width, settings, is_check(i - 1), keep)
        ranks = {t.normal: t.spec.k for t in live}
        sums = passes.run(step, shapes, rows=rows, ranks=ranks, ridge=settings.ridge) if keep else passes.sum_up(step, shapes, ranks, settings.ridge)
        told.unpersist()
        if keep:
            pending = []
        rows = None
        for t in live:
            loss, size_a, cells, bad_a, bad_w = sums[t.scalars][0]
            if i:
                t.losses.append(loss)
                if cells != t.size:
                    raise ValueError("(grp, obj_id) must be unique")
            t.size = cells
            if later and is_check(i - 1):
                if settings.conv == "max_frac_A":
                    done = sums[-1 - t.scalars][0] / (size_a / cells) < settings.tol
                else:
                    done = abs(t.seen_loss - loss) / abs(loss) < settings.tol
                t.seen_loss = loss
                if done:
                    # cycle i - 1 was the last one; its coefficients are the ones just remembered
                    t.live, t.converged, t.from_seen, t.t = False, True, True, np.eye(t.spec.k)
                    continue
            k = t.spec.k
            g = sums[t.normal]
            t.bad.append((int(bad_a), int(np.isnan(g).sum()), int(bad_w)))
            if any(t.bad[-1]):
                # no later cycle mends it; the counts tell where it began
                t.live, t.g, t.t, t.start, t.n_iter = False, g, np.eye(k), None, i + 1
                continue
            turn, back = _rotation(settings, sums[t.gram], g.T @ g) if i else rotate.identity(k)
            t.g, t.t, t.start, t.n_iter = g @ back, turn, None, i + 1
            t.gram_a = turn.T @ sums[t.gram] @ turn
            if is_check(i):
                if stops(settings, t.n_iter, t.g, t.seen_g, t.losses):
                    t.live, t.converged = False, True
                t.seen_g = t.g
        passes.forget_before()
        if not any(t.live for t in turns):
            break

    told = [t.told() for t in turns]
    due = [later and t.live and is_check(t.n_iter - 1) for t in turns]
    for t, m, check in zip(turns, told, due):
        m["check"] = t.t if check and settings.conv == "max_frac_A" else None
        if settings.order and not any(t.bad[-1]):
            turn, back = rotate.principal(t.gram_a, t.g.T @ t.g)
            m["t"], m["g"] = t.t @ turn, t.g @ back
            t.g = m["g"]
    finish = _finish_step(sc.broadcast(told), width, sc.broadcast(pending), settings)
    sums = passes.run(finish, {t.scalars: (1, 3) for t in turns})
    for t, check in zip(turns, due):
        loss, size_a, cells = sums[t.scalars][0]
        if check and settings.conv == "max_frac_A":
            t.converged = bool(sums[-1 - t.scalars][0] / (np.trace(t.gram_a) / cells) < settings.tol)
        elif check:
            t.converged = bool(abs(t.seen_loss - loss) / abs(loss) < settings.tol)
    final = passes.state
    passes.forget_before(1)
    passes._live.clear()
    out = {}
    for t in turns:
        if len(t.losses) < t.n_iter:
            t.losses.append(sums[t.scalars][0][0])
        n_valid = F.get("state", F.lit(width)).cast("int")
        a = F.when(n_valid > 0, F.slice("state", t.offset + 1, t.spec.k)).alias("a")
        mine = F.col("grp") == t.spec.grp
        coeffs = final.filter(mine).select("obj_id", a, n_valid.alias("n_valid"))
        training = passes.rows(final).filter(mine).select("obj_id", "y", "w", a, n_valid.alias("n_valid"))
        out[t.spec.model_id] = FittedModel(
            passes.spark, t.spec, t.g, coeffs, [float(x) for x in t.losses], t.n_iter, t.converged, settings.ridge, training, (final, a), t.bad
        )
    return out


def coefficient_table(models: list[FittedModel]) -> DataFrame | None:
    """(model_id, obj_id, a) of several models; those fitted together are read in one scan."""
    parts: list[DataFrame] = []
    shared: dict[int, list[FittedModel]] = {}
    for m in models:
        if m.slot is not None:
            shared.setdefault(id(m.slot[0]), []).append(m)
        elif m.coeffs is not None:
            parts.append(m.coeffs.select(F.lit(m.model_id).alias("model_id"), "obj_id", "a"))
    for ms in shared.values():
        entry = None
        for grp in sorted({m.spec.grp for m in ms}):
            own = F.array(*[F.struct(F.lit(m.model_id).alias("model_id"), m.slot[1]) for m in ms if m.spec.grp == grp])
            entry = F.when(F.col("grp") == grp, own) if entry is None else entry.when(F.col("grp") == grp, own)
        rows = ms[0].slot[0].select("obj_id", F.explode(entry).alias("c"))
        parts.append(rows.select("c.model_id", "obj_id", "c.a"))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


class Factorizer:
    """One robust factorisation ``Y ~ A Gᵀ``; the settings of ``fit`` gathered in one place."""

    def __init__(
        self,
        k: int,
        *,
        robust: bool = True,
        nu: float = 1.0,
        scale: float = 1.0,
        loss: Loss | None = None,
        method: str = "als",
        learning_rate: float = 1e-3,
        rotate_every: int | None = None,
        optimiser=None,
        **settings,
    ):
        if method not in ("als", "sgd"):
            raise ValueError(f"method must be 'als' or 'sgd', got {method!r}")
        if rotate_every is not None and (method != "sgd" or rotate_every < 1):
            raise ValueError("rotate_every is a number of gradient steps; the alternating fit rotates every cycle")
        if method == "sgd" and settings.get("reweight", "once") != "once":
            raise ValueError("a gradient step weighs every cell once")
        if optimiser is not None and method != "sgd":
            raise ValueError("an optimiser takes gradient steps; the alternating fit solves its systems")
        if k < 1:
            raise ValueError(f"rank must be at least 1, got {k}")
        self.k = k
        self.loss = loss or (StudentT(nu, scale) if robust else Gaussian())
        self.method = method
        self.learning_rate = learning_rate
        self.rotate_every = rotate_every
        self.optimiser = optimiser
        self.settings = Settings(**settings)

    def fit(self, objects: DataFrame, model_id: str = "model", start: FittedModel | tuple | None = None, buckets: int | None = None, **changes) -> FittedModel:
        """Fit to ``objects(obj_id, y, w)``. ``start`` is a model to go on from, or (G, coefficients)."""
        settings = replace(self.settings, **changes)
        spec = ModelSpec(model_id, self.k, self.loss)
        init = None
        if start is not None:
            init = {model_id: (start.g, start.coeffs) if isinstance(start, FittedModel) else start}
            settings = replace(settings, init="custom")
        rows = objects.select(F.lit(0).alias("grp"), F.col("obj_id").cast("bigint").alias("obj_id"), "y", "w")
        if self.method == "sgd":
            from plumbline.plans.gradient import fit_gradient

            return fit_gradient(rows, spec, settings, init, self.learning_rate, buckets, self.rotate_every, self.optimiser)
        return fit_many(rows, [spec], settings, init, buckets)[model_id]
