"""Postfix token formulas: vocabulary, checks, and compilation to staged plans."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from barloom.operators import features, language_a
from barloom.plans.staged import Plan

MAX_TOKENS = 8


class RegistrationError(ValueError):
    """A feature or operator that can't be registered."""


class VocabularyError(ValueError):
    """A formula written for another vocabulary."""


@dataclass(frozen=True)
class Vocabulary:
    """Features, then operators; a token is an index in their joint order, which the version pins."""

    feature_names: tuple[str, ...]
    operator_names: tuple[str, ...]

    @staticmethod
    def default(allowed: set[str] | None = None) -> Vocabulary:
        return Vocabulary(tuple(f for f in features.FEATURES if allowed is None or f in allowed), tuple(language_a.OPERATORS))

    @property
    def names(self) -> tuple[str, ...]:
        return self.feature_names + self.operator_names

    @property
    def version(self) -> str:
        return "v" + hashlib.sha256("\n".join(self.names).encode()).hexdigest()[:12]

    def verify(self, version: str) -> None:
        if version != self.version:
            raise VocabularyError(f"formula of vocabulary {version}, but this one is {self.version}")

    def encode(self, names: list[str]) -> list[int]:
        return [self.names.index(n) for n in names]


def register_feature(name: str, category: str, build) -> None:
    if not name or not name.isidentifier():
        raise RegistrationError(f"bad name {name!r}")
    if name in features.FEATURES or name in language_a.OPERATORS:
        raise RegistrationError(f"{name} is taken")
    features.feature(name, category)(build)


def register_operator(name: str, arity: int, build) -> None:
    if not name or not name.isidentifier():
        raise RegistrationError(f"bad name {name!r}")
    if name in features.FEATURES or name in language_a.OPERATORS:
        raise RegistrationError(f"{name} is taken")
    if arity not in (1, 2, 3):
        raise RegistrationError(f"arity {arity} isn't 1, 2 or 3")
    language_a.operator(name, arity)(build)


# Operators whose output is never negative, that keep such input so, and that end it.
POSITIVE = {"TS_RANK_5", "TS_RANK_10", "TS_RANK_20", "ABS"}
KEEPING = POSITIVE | {"TS_SUM_5", "TS_SUM_10", "TS_SUM_20", "TS_MEAN_5", "TS_MEAN_10", "TS_MEAN_20", "TS_MAX_10", "TS_MAX_20", "CLIP", "SQRT", "POWER", "SIGNED_LOG", "SIGMOID", "TANH_SQUASH", "WINSORIZE", "WMA", "EMA_5", "EMA_20", "DECAY", "DECAY_LINEAR_5", "TS_DECAY_EXP_5"}
RESTORING = {"SUB", "DIV", "NEG", "GATE", "IF_GT", "TS_ZSCORE_10", "TS_ZSCORE_20", "CS_NEUTRALIZE", "CS_RANK", "CS_SCALE", "TS_STD_5", "TS_STD_10", "TS_STD_20", "TS_CORR_10", "TS_SKEW_10", "TS_QUANTILE_10", "DELTA", "DELTA_5", "MOMENTUM_5", "MOMENTUM_10"}


def check_sign(tokens: list[int], vocab: Vocabulary) -> list[str]:
    """Complaints about values that stay non-negative: chains of three such steps, and formulas that end in one of two or more."""
    out: list[str] = []
    run = 0
    for i, t in enumerate(tokens):
        name = vocab.names[t]
        if name not in language_a.OPERATORS:
            continue
        if name in POSITIVE:
            run += 1
        elif run and name in RESTORING:
            run = 0
        elif run and name in KEEPING:
            run += 1
            if run >= 3:
                out.append(f"step {i}: {run} steps without a sign")
    if run >= 2:
        out.append(f"ends without a sign after {run} steps")
    return out


def depth_after(tokens: list[int], vocab: Vocabulary) -> int | None:
    """Stack depth after the tokens; None if an operator lacks operands."""
    depth = 0
    for t in tokens:
        op = language_a.OPERATORS.get(vocab.names[t])
        if op and depth < op.arity:
            return None
        depth += 1 - op.arity if op else 1
    return depth


def valid_next(tokens: list[int], vocab: Vocabulary, length: int = MAX_TOKENS) -> list[int]:
    """Tokens after which a formula of `length` tokens can still end with one value."""
    left, out = length - len(tokens) - 1, []
    for t in range(len(vocab.names)):
        d = depth_after([*tokens, t], vocab)
        if d is not None and 1 <= d <= 1 + 2 * left and (left > 0 or d == 1):
            out.append(t)
    return out


def execute(p: Plan, tokens: list[int], vocab: Vocabulary | None = None, normalize: bool = True) -> str | None:
    """The formula's column; None if it isn't well formed."""
    vocab = vocab or Vocabulary.default()
    if not tokens or any(not 0 <= t < len(vocab.names) for t in tokens) or depth_after(tokens, vocab) != 1:
        return None
    stack: list[str] = []
    for t in tokens:
        name = vocab.names[t]
        if name in features.FEATURES:
            stack.append(p.let(features.FEATURES[name].build(p)))
        else:
            n = language_a.OPERATORS[name].arity
            args = stack[-n:]
            del stack[-n:]
            stack.append(language_a.apply(p, name, *args))
    return normalized(p, stack[0]) if normalize else stack[0]


def normalized(p: Plan, x: str) -> str:
    """Cross-section z (sample deviation, floor 1e-8) within 3; expanding z at times of one symbol.

    A column that is constant everywhere has z 0 in either case but the floor keeps it finite, so no global
    statistic, which would need all rows in one place, is taken.
    """
    n = p.let("count(*) over (partition by ts)")
    m, s = p.let(f"avg({x}) over (partition by ts)"), p.let(f"coalesce(stddev_samp({x}) over (partition by ts), 0e0)")
    em, ev = p.let(f"avg({x}) {p.k.ever}"), p.let(f"var_pop({x}) {p.k.ever}")
    z = f"({x} - {m}) / greatest({s}, 1e-8)"
    ez = f"({x} - {em}) / sqrt(greatest({ev}, 1e-8))"
    return p.k.clamp(f"(case when {n} > 1 then {z} else {ez} end)", "-3e0", "3e0")


def formula_hash(formula: list[int], version: str) -> str:
    return hashlib.sha256(f"{json.dumps(formula)}|{version}".encode()).hexdigest()[:12]
