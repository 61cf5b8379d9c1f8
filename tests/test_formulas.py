import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from barloom.operators import features, language_a
from barloom.plans import formula_a, formula_b
from barloom.plans.staged import SPARK, Plan

VOCAB = formula_a.Vocabulary.default()


@given(st.tuples(*[st.integers(0, len(s) - 1) for s in formula_b.SPACES]))
def test_genes_round_trip(genes):
    f = formula_b.decode(list(genes))
    assert f.genes() == formula_b.normalized(list(genes))
    assert formula_b.decode(f.genes()) == f


def test_genes_of_wrong_length():
    with pytest.raises(ValueError, match="10 genes"):
        formula_b.normalized([0] * 9)


def test_vocabulary():
    assert len(VOCAB.feature_names) == 65 and len(VOCAB.operator_names) == 62
    assert VOCAB.names[65] == "ADD" and VOCAB.names[126] == "IF_GT"
    VOCAB.verify(VOCAB.version)
    with pytest.raises(formula_a.VocabularyError):
        VOCAB.verify("v0")
    assert formula_a.Vocabulary.default({"RET"}).version != VOCAB.version


@given(st.lists(st.integers(0, 126), max_size=8))
def test_any_tokens_compile_or_are_refused(tokens):
    out = formula_a.execute(Plan(SPARK), tokens, VOCAB)
    assert (out is None) == (not tokens or formula_a.depth_after(tokens, VOCAB) != 1)


@given(st.randoms(use_true_random=False))
def test_valid_next_ends_with_one_value(rng):
    tokens = []
    while len(tokens) < 5:
        tokens.append(rng.choice(formula_a.valid_next(tokens, VOCAB, 5)))
    assert formula_a.depth_after(tokens, VOCAB) == 1


def test_sign_check():
    code = VOCAB.encode
    assert formula_a.check_sign(code(["RET", "ABS", "TS_SUM_5", "SQRT"]), VOCAB)
    assert formula_a.check_sign(code(["RET", "ABS", "TS_ZSCORE_10"]), VOCAB) == []


def test_registration():
    with pytest.raises(formula_a.RegistrationError):
        formula_a.register_operator("ADD", 2, None)
    with pytest.raises(formula_a.RegistrationError):
        formula_a.register_operator("NEW_ONE", 4, None)
    formula_a.register_operator("TWICE", 1, lambda p, x: f"2e0 * {x}")
    assert language_a.apply(Plan(SPARK), "TWICE", "close")
    del language_a.OPERATORS["TWICE"]
    assert len(features.FEATURES) == 65
    assert np.isfinite(len(formula_a.formula_hash([1, 2], VOCAB.version)))
