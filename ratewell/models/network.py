"""The two gated networks: layout, start values, forward pass and gradients of one block of rows.

PLE and MMoE differ only in how many experts a level has and in PLE's gate for a shared mix. In both,
all experts of a level read the raw features, each task's gate mixes all of them, and from the second
level on the gates read the mix their task got before. All experts of a level are therefore one stack.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np

TASKS = ("income", "never")
_EPSILON = 1e-5


@dataclass(frozen=True)
class NetworkConfig:
    """Shape of a network; ``kind`` is ``ple`` or ``mmoe``. The defaults are fixed values."""

    kind: str
    d_in: int
    d_model: int = 128
    expert_hidden: int = 256
    num_levels: int = 2
    num_shared_experts: int = 2
    num_task_experts: int = 2
    num_experts: int = 4
    dropout: float = 0.0

    def __post_init__(self) -> None:
        if self.kind not in ("ple", "mmoe"):
            raise ValueError(f"unknown kind of network: {self.kind!r}")
        if self.kind == "ple" and self.num_levels != 2:
            raise ValueError("a PLE network has exactly 2 levels")
        if self.num_levels < 1:
            raise ValueError("a network needs at least one level")
        if self.experts < 1:
            raise ValueError("a level needs at least one expert")

    @property
    def experts(self) -> int:
        if self.kind == "mmoe":
            return self.num_experts
        return max(0, self.num_shared_experts) + 2 * max(0, self.num_task_experts)

    @property
    def gates(self) -> tuple[str, ...]:
        """PLE also has a gate for a shared mix; no output depends on it."""
        return (*TASKS, "shared") if self.kind == "ple" else TASKS

    def layout(self) -> dict[str, tuple[tuple[int, ...], int]]:
        """Parameter name to shape and fan-in; 0 marks biases, -1 scales that start at one."""
        e, h, m, d = self.experts, self.expert_hidden, self.d_model, self.d_in
        t = max(1, m // 2)
        shapes: dict[str, tuple[tuple[int, ...], int]] = {}
        for level in range(1, self.num_levels + 1):
            s = d if level == 1 else m
            shapes[f"{level}.hidden.weight"] = ((e, d, h), d)
            shapes[f"{level}.hidden.bias"] = ((e, 1, h), 0)
            shapes[f"{level}.out.weight"] = ((e, h, m), h)
            shapes[f"{level}.out.bias"] = ((e, 1, m), 0)
            shapes[f"{level}.norm.weight"] = ((e, 1, m), -1)
            shapes[f"{level}.norm.bias"] = ((e, 1, m), 0)
            for gate in self.gates:
                shapes[f"{level}.gate.{gate}.weight"] = ((s, e), s)
                shapes[f"{level}.gate.{gate}.bias"] = ((e,), 0)
        for task in TASKS:
            shapes[f"tower.{task}.hidden.weight"] = ((m, t), m)
            shapes[f"tower.{task}.hidden.bias"] = ((t,), 0)
            shapes[f"tower.{task}.out.weight"] = ((t, 1), t)
            shapes[f"tower.{task}.out.bias"] = ((1,), 0)
        return shapes

    def trained(self) -> list[str]:
        """Parameters that an output depends on, in layout order."""
        return [name for name in self.layout() if ".gate.shared." not in name]

    def wide(self) -> list[str]:
        """Trained parameters with a row for each input cell: those that meet the raw features."""
        gates = [f"1.gate.{t}.weight" for t in TASKS]
        return [f"{level}.hidden.weight" for level in range(1, self.num_levels + 1)] + gates


Params = Mapping[str, np.ndarray]


def initial_params(config: NetworkConfig, seed: int) -> dict[str, np.ndarray]:
    """Weights uniform within 1/sqrt(fan-in), biases zero, scales one."""
    rng = np.random.default_rng(seed)
    params = {}
    for name, (shape, fan_in) in config.layout().items():
        if fan_in > 0:
            params[name] = rng.uniform(-1.0, 1.0, shape) / np.sqrt(fan_in)
        else:
            params[name] = np.full(shape, 1.0 if fan_in < 0 else 0.0)
    return params


@dataclass(frozen=True)
class SparseBlock:
    """Rows of numeric cells, which come first, and of places that hold a one; -1 stands for none."""

    numeric: np.ndarray
    slots: np.ndarray

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        """What the dense rows would give, from the rows of ``w`` that their slots name."""
        out = self.numeric @ w[..., : self.numeric.shape[1], :]
        for at in self.slots.T:
            there = np.flatnonzero(at >= 0)
            out[..., there, :] += w[..., at[there], :]
        return out

    def by_weight(self, g: np.ndarray) -> SlotGradient:
        """What the transposed dense rows times ``g`` would give, for the slots that were met."""
        row, turn = np.nonzero(self.slots >= 0)
        place = self.slots[row, turn]
        order = np.argsort(place, kind="stable")
        ids, first = np.unique(place[order], return_index=True)
        met = g[..., row[order], :]
        rows = np.add.reduceat(met, first, axis=-2) if len(ids) else met
        return SlotGradient(self.numeric.T @ g, ids, rows)


@dataclass(frozen=True)
class SlotGradient:
    """Gradient of a wide parameter: of the rows of numeric cells, and of the rows ``ids`` only."""

    numeric: np.ndarray
    ids: np.ndarray
    rows: np.ndarray


def _by_weight(x: np.ndarray | SparseBlock, g: np.ndarray) -> np.ndarray | SlotGradient:
    return x.by_weight(g) if isinstance(x, SparseBlock) else x.T @ g


def slot_rows(wide: Sequence[np.ndarray]) -> np.ndarray:
    """One row per slot from the rows of all wide parameters; those hold slots in their last axis but one."""
    return np.concatenate([np.moveaxis(w, -2, 0).reshape(w.shape[-2], -1) for w in wide], axis=1)


def from_slot_rows(rows: np.ndarray, like: Sequence[tuple[int, ...]]) -> list[np.ndarray]:
    """The inverse of :func:`slot_rows`, for shapes whose number of slots plays no part."""
    out, at = [], 0
    for shape in like:
        rest = (*shape[:-2], shape[-1])
        size = int(np.prod(rest))
        out.append(np.moveaxis(rows[:, at : at + size].reshape(len(rows), *rest), 0, -2))
        at += size
    return out


def _softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def forward(
    config: NetworkConfig, p: Params, x: np.ndarray | SparseBlock, rng: np.random.Generator | None = None
) -> tuple[np.ndarray, list[dict]]:
    """Logits ``(rows, 2)`` and what each level computed. A generator switches dropout on."""
    selectors = {t: x for t in TASKS}
    levels = []
    for level in range(1, config.num_levels + 1):
        hidden = np.maximum(x @ p[f"{level}.hidden.weight"] + p[f"{level}.hidden.bias"], 0.0)
        keep = 1.0
        if rng is not None and config.dropout > 0:
            keep = (rng.random(hidden.shape) >= config.dropout) / (1.0 - config.dropout)
        dropped = hidden * keep
        raw = dropped @ p[f"{level}.out.weight"] + p[f"{level}.out.bias"]
        spread = np.sqrt(raw.var(axis=2, keepdims=True) + _EPSILON)
        unit = (raw - raw.mean(axis=2, keepdims=True)) / spread
        out = unit * p[f"{level}.norm.weight"] + p[f"{level}.norm.bias"]
        gates = {
            t: _softmax(
                selectors[t] @ p[f"{level}.gate.{t}.weight"] + p[f"{level}.gate.{t}.bias"]
            )
            for t in TASKS
        }
        levels.append(
            dict(hidden=hidden, keep=keep, dropped=dropped, spread=spread, unit=unit, out=out,
                 gates=gates, selectors=selectors)
        )
        selectors = {t: np.einsum("ne,enm->nm", gates[t], out) for t in TASKS}
    logits = []
    for t in TASKS:
        u = np.maximum(selectors[t] @ p[f"tower.{t}.hidden.weight"] + p[f"tower.{t}.hidden.bias"], 0.0)
        logits.append(u @ p[f"tower.{t}.out.weight"] + p[f"tower.{t}.out.bias"])
    return np.concatenate(logits, axis=1), [*levels, dict(mixes=selectors)]


def task_losses(
    logits: np.ndarray, labels: np.ndarray, pos_weights: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per row and task, and its derivative by the logit."""
    weight = 1.0 + (pos_weights - 1.0) * labels
    loss = (1.0 - labels) * logits + weight * (
        np.log1p(np.exp(-np.abs(logits))) + np.maximum(-logits, 0.0)
    )
    below = np.exp(-np.logaddexp(0.0, logits))  # 1 - sigmoid, without overflow
    return loss, (1.0 - labels) - weight * below


def gradients(
    config: NetworkConfig, p: Params, x: np.ndarray | SparseBlock, levels: list[dict], by_logit: np.ndarray
) -> dict[str, np.ndarray | SlotGradient]:
    """Gradient of a sum over rows, from its derivative by the logits ``(rows, 2)``.

    Of sparse rows the wide parameters have the gradient of the slots that were met.
    """
    g: dict[str, np.ndarray] = {}
    by_mix = {}
    for i, t in enumerate(TASKS):
        mix, name = levels[-1]["mixes"][t], f"tower.{t}"
        u = np.maximum(mix @ p[f"{name}.hidden.weight"] + p[f"{name}.hidden.bias"], 0.0)
        top = by_logit[:, [i]]
        g[f"{name}.out.weight"], g[f"{name}.out.bias"] = u.T @ top, top.sum(axis=0)
        by_u = (top @ p[f"{name}.out.weight"].T) * (u > 0)
        g[f"{name}.hidden.weight"], g[f"{name}.hidden.bias"] = mix.T @ by_u, by_u.sum(axis=0)
        by_mix[t] = by_u @ p[f"{name}.hidden.weight"].T
    for level in range(config.num_levels, 0, -1):
        c = levels[level - 1]
        by_out = np.zeros_like(c["out"])
        by_selector = {}
        for t in TASKS:
            w = c["gates"][t]
            by_out += w.T[:, :, None] * by_mix[t]
            by_w = np.einsum("nm,enm->ne", by_mix[t], c["out"])
            by_gate = w * (by_w - (by_w * w).sum(axis=1, keepdims=True))
            g[f"{level}.gate.{t}.weight"] = _by_weight(c["selectors"][t], by_gate)
            g[f"{level}.gate.{t}.bias"] = by_gate.sum(axis=0)
            if level > 1:
                by_selector[t] = by_gate @ p[f"{level}.gate.{t}.weight"].T
        g[f"{level}.norm.weight"] = (by_out * c["unit"]).sum(axis=1, keepdims=True)
        g[f"{level}.norm.bias"] = by_out.sum(axis=1, keepdims=True)
        by_unit = by_out * p[f"{level}.norm.weight"]
        along = (by_unit * c["unit"]).mean(axis=2, keepdims=True)
        by_raw = (by_unit - by_unit.mean(axis=2, keepdims=True) - c["unit"] * along) / c["spread"]
        g[f"{level}.out.weight"] = c["dropped"].transpose(0, 2, 1) @ by_raw
        g[f"{level}.out.bias"] = by_raw.sum(axis=1, keepdims=True)
        by_hidden = (by_raw @ p[f"{level}.out.weight"].transpose(0, 2, 1)) * c["keep"]
        by_hidden = by_hidden * (c["hidden"] > 0)
        g[f"{level}.hidden.weight"] = _by_weight(x, by_hidden)
        g[f"{level}.hidden.bias"] = by_hidden.sum(axis=1, keepdims=True)
        by_mix = by_selector  # the selectors of this level are the mixes of the one below
    return g
