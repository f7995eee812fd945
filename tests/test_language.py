from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import tessellum as ts
from tessellum import inspect
from tessellum.functions.scalars import BINARY, UNARY, register
from tessellum.lang.syntax import parse

#: Statements with their numbers of operators and of loops.
PROGRAMS = [
    ("Mean = Sum / Count", 1, 0),
    ("Half = Whole", 0, 0),
    ("Ramp[n] = n", 0, 1),
    ("Ones[p,q] = 1", 0, 2),
    ("Trace += M[p,p]", 0, 1),
    ("Column[q] += M[p,q]", 0, 2),
    ("Scaled[p,q] = M[p,q] * Factor", 1, 2),
    ("Gap[p] = Upper[p] - Lower[p]", 1, 1),
    ("Outer[p,q,r,s] = M[p,q] * N[r,s]", 1, 4),
    ("Energy += (Charge[p] * Charge[q]) / Range[p,q]", 2, 2),
    ("Norm += (M[p,q] - N[p,q]) * (M[p,q] - N[p,q]) * Weight[q]", 4, 2),
    ("Hits[p] += (M[p,q] > Low) && (M[p,q] < High)", 3, 2),
]


@pytest.mark.parametrize(("code", "ops", "loops"), PROGRAMS)
def test_structure(code, ops, loops):
    (s,) = ts.compile(code).statements
    assert (s.op_count, s.loop_count, s.raw) == (ops, loops, code)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_random_text_is_rejected_or_parsed(text):
    try:
        ts.compile(text)
    except ValueError as e:
        assert "Invalid program" in str(e)


@pytest.mark.parametrize("code", ["", "A", "A = ", "a = B", "A[i = B", "A = B +", "A = nope(B)", "A[I] = B", "A = B C", "A[i] = B[i]\nA[i,j] = B[i]", "A = 1 ** 2"])
def test_invalid(code):
    with pytest.raises(ValueError, match="Invalid program"):
        ts.compile(code)


def test_flat_precedence_and_literals():
    (s,) = parse("A = 2 * B ^ 2 + -1.5")
    assert s.expression.operator == "+"
    assert s.expression.left.operator == "^"
    assert s.expression.right.value == -1.5


def run(spark, code, output, hints=None, **arrays):
    tensors = {k: ts.from_values(spark, v) for k, v in arrays.items()}
    return ts.to_numpy(ts.compile(code).execute(tensors, hints, spark)[output])


RNG = np.random.default_rng(5)
A, B, C, SQ = RNG.normal(size=(3, 4)), RNG.normal(size=(4, 5)), RNG.normal(size=3), RNG.normal(size=(4, 4))
X4 = RNG.normal(size=(2, 3, 2, 2))


@pytest.mark.parametrize(
    ("code", "arrays", "want", "hints"),
    [
        ("R[i,j] += A[i,k] * B[k,j]", {"A": A, "B": B}, A @ B, None),
        ("R += A[i,j]", {"A": A}, A.sum(), None),
        ("R[i] += A[i,j,k,l]", {"A": X4}, X4.sum((1, 2, 3)), None),
        ("R[j] -= A[i,j]", {"A": A}, -A.sum(0), None),
        ("R[j] *= A[i,j]", {"A": A}, A.prod(0), None),
        ("R[j] /= A[i,j]", {"A": A}, 0 / A.prod(0), None),
        ("R[i] += A[i]", {"A": C}, C, None),
        ("R[i,j] = A[i,j] + C[i] * 2", {"A": A, "C": C}, (A + C[:, None]) * 2, None),
        ("R[i] = A[i,j]", {"A": A}, A[:, -1], None),
        ("R[j] = A[1,j]", {"A": A}, A[1], None),
        ("R[i] = S[i,i]", {"S": SQ}, np.diag(SQ), None),
        ("R[i,j] = S[i,j] + S[j,i] + i", {"S": SQ}, SQ + SQ.T + np.arange(4)[:, None], None),
        ("T[(ij)] = A[i,j]\nR[k,l] = T[(kl)]", {"A": A}, A.reshape(6, 2), {"R": (6, 2)}),
        ("R[i,j] = A[i] * C[j]", {"A": C, "C": C}, np.outer(C, C), None),
        ("R[i,j] = 0\nR[0,j] = A[1,j]", {"A": A}, np.vstack([A[1], np.zeros(4)]), {"R": (2, 4)}),
        ("R[j] = 10000\nR[j] = (X[i,j] < R[j]) * (X[i,j] - R[j]) + R[j]", {"X": np.round(SQ * 8)}, np.round(SQ * 8).min(0), {"R": (4,)}),
        ("R[i] = -A[i] + 0.5", {"A": C}, 0.5 - C, None),
        ("R[i] = i", {}, np.arange(5.0), {"R": (5,)}),
        ("R += A[i] * A[i]", {"A": C}, (C * C).sum(), None),
        ("R[k,l] += A[i,j]", {"A": A}, np.full((2, 2), A.sum()), {"R": (2, 2)}),
        ("R += A[i,j] * B[k,l] * 2", {"A": A, "B": B}, 2 * A.sum() * B.sum(), None),
    ],
)
def test_programs(spark, code, arrays, want, hints):
    assert np.allclose(run(spark, code, "R", hints, **arrays), want, atol=1e-12)


SPECIAL = [0.0, -0.0, 1.0, -1.5, 2.0, 0.3, math.inf, -math.inf, math.nan]


def test_scalars_follow_ieee(spark):
    a, b = (np.array(v) for v in zip(*[(x, y) for x in SPECIAL for y in SPECIAL], strict=True))
    calls = {"+": np.add, "-": np.subtract, "*": np.multiply, "/": np.divide, "==": np.equal, "!=": np.not_equal, "<": np.less, ">": np.greater, "<=": np.less_equal, ">=": np.greater_equal, "^": np.power}
    with np.errstate(all="ignore"):
        for op, f in calls.items():
            got = run(spark, f"R[i] = A[i] {op} B[i]", "R", None, A=a, B=b)
            want = f(a, b).astype(float)
            same = np.isclose(got, want, equal_nan=True)
            if op == "^":  # powers of one and minus one with infinite or NaN exponents differ between platforms
                same |= (np.abs(a) == 1) | np.isnan(b)
            assert same.all(), (op, a[~same], b[~same], got[~same], want[~same])
        logic = run(spark, "R[i] = (A[i] && B[i]) + ((A[i] || B[i]) * 10)", "R", None, A=a, B=b)
        assert np.array_equal(logic, ((a != 0) & (b != 0)) + 10.0 * ((a != 0) | (b != 0)))
        x = np.array(SPECIAL)
        names = {"asin": "arcsin", "acos": "arccos", "atan": "arctan", "asinh": "arcsinh", "acosh": "arccosh", "atanh": "arctanh"}
        for name in ("abs", "exp", "log", "log2", "log10", "sqrt", "sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh", "ceil", "floor"):
            got = run(spark, f"R[i] = {name}(A[i])", "R", None, A=x)
            want = getattr(np, names.get(name, name))(x)
            assert np.allclose(got, want, equal_nan=True), (name, got, want)
    assert len(BINARY) == 13 and len(UNARY) >= 20


def test_registered_function(spark):
    register("twice", lambda a: a * 2)
    try:
        assert np.allclose(run(spark, "R[i] = twice(A[i])", "R", None, A=C), 2 * C)
    finally:
        del UNARY["twice"]


def test_dtypes(spark):
    whole = ts.from_values(spark, [[1, 2], [3, 4]], "bigint")
    real = ts.from_values(spark, [[0.5, 1.0], [1.5, 2.0]])
    out = ts.compile("H[i,j] = W[i,j] / 2\nM[i,j] = W[i,j] * F[i,j]").execute({"W": whole, "F": real}, None, spark)
    assert out["H"].dtype == "bigint" and ts.to_numpy(out["H"]).tolist() == [[0, 1], [1, 2]]
    assert out["M"].dtype == "double" and ts.to_numpy(out["M"]).tolist() == [[0.5, 2.0], [4.5, 8.0]]
    near = ts.from_values(spark, [1.0, 2.0], "float")
    assert ts.to_numpy(ts.evaluate("R[i] = (N[i] == 1)", {"N": near}, None, spark)).tolist() == [1.0, 0.0]


def test_evaluate_accumulates(spark):
    old = ts.from_values(spark, np.array([10.0, 20.0, 30.0]))
    a = ts.from_values(spark, A)
    assert np.allclose(ts.to_numpy(ts.evaluate("R[i] += A[i,j]", {"A": a, "R": old}, None, spark)), [10, 20, 30] + A.sum(1))


@pytest.mark.parametrize(
    ("code", "arrays", "hints"),
    [
        ("R[i] = A[i,j]", {}, None),
        ("R[i] = A[i]", {"A": A}, None),
        ("R[i] = A[3,i]", {"A": A}, None),
        ("R[i] = A[i,j] + C[j]", {"A": A, "C": C}, None),
        ("R[i] = i", {}, None),
        ("R[0,j] = C[j]", {"C": C}, None),
        ("R[i,j] = A[i,j]\nR[i,j] = R[j,i]", {"A": SQ}, None),
        ("R[i,j] = A[i,j]", {"A": A}, {"R": (3,)}),
    ],
)
def test_errors(spark, code, arrays, hints):
    with pytest.raises(ValueError):
        run(spark, code, "R", hints, **arrays)


def test_latest_value_of_a_name(spark):
    got = run(spark, "T[i] = A[i]\nU[i] = T[i] + 1\nT[i] = A[i] * 5\nR[i] = U[i] + T[i]", "R", None, A=C)
    assert np.allclose(got, C + 1 + 5 * C)


def test_attention(spark):
    x, wo = RNG.normal(size=(2, 3, 4)), RNG.normal(size=(4, 4))
    wq, wk, wv = (RNG.normal(size=(2, 4, 2)) for _ in range(3))
    code = """
    Q[i,j,k,l] += X[i,k,m] * Wq[j,m,l]   # heads
    K[i,j,k,l] += X[i,k,m] * Wk[j,m,l]
    V[i,j,k,l] += X[i,k,m] * Wv[j,m,l]
    A[i,j,k,m] += (Q[i,j,k,l] * K[i,j,m,l]) / Root
    Denom[i,j,k] += exp(A[i,j,k,m])
    Soft[i,j,k,m] = exp(A[i,j,k,m]) / Denom[i,j,k]
    Atte[i,j,(kl)] += Soft[i,k,j,m] * V[i,k,m,l]
    Z[i,j,l] += Atte[i,j,k] * Wo[l,k]
    """
    q, k, v = (np.einsum("bsm,hme->bhse", x, w) for w in (wq, wk, wv))
    e = np.exp(np.einsum("bhse,bhte->bhst", q, k) / math.sqrt(2))
    want = np.einsum("bhst,bhte->bshe", e / e.sum(-1, keepdims=True), v).reshape(2, 3, 4) @ wo.T
    assert np.allclose(run(spark, code, "Z", None, X=x, Wq=wq, Wk=wk, Wv=wv, Wo=wo, Root=np.array(math.sqrt(2))), want)


def test_reduced_values_are_filtered_before_the_join(spark):
    a = ts.from_values(spark, A)
    plan = ts.compile("R[i] = A[i,j] * A[i,j]").execute({"A": a}, None, spark)["R"].frame._jdf.queryExecution().optimizedPlan().toString()
    assert "= 3" in plan and "Aggregate" not in plan


def test_structure_frames(spark):
    p = ts.compile("D[i] += A[i,j]\nR[i] = D[i] / N\nD[i] = sin(-R[i])")
    assert p.input_variables == ("A", "N")
    assert p.variables["A"].lines == (-1, 1) and p.max_loop_depth == (2, 1) and p.max_op_count[0] == 1
    nodes = {r["node"]: r["level"] for r in inspect.program_nodes(spark, p, "type").collect()}
    assert nodes == {"A": 0, "N": 0, "0:D": 1, "1:R": 2, "2:D": 3}
    assert {(r["source"], r["target"]) for r in inspect.program_edges(spark, p).collect()} == {("A", "0:D"), ("0:D", "1:R"), ("N", "1:R"), ("1:R", "2:D")}
    labels = [r["label"] for r in inspect.expression_nodes(spark, p.statements[2]).orderBy("id").collect()]
    assert labels == ["D[i] =", "sin", "neg", "R[i]"]
    with pytest.raises(ValueError):
        inspect.program_nodes(spark, p, "size")
    assert p.statement_stats(spark).count() == 3 and p.variable_usage(spark).count() == 4


def test_tensors(spark, tmp_path):
    from tessellum.sources import read_tensor, write_tensor

    t = ts.from_values(spark, A)
    write_tensor(t, str(tmp_path / "a"))
    back = read_tensor(spark, str(tmp_path / "a"))
    assert back.shape == (3, 4) and np.array_equal(ts.to_numpy(back), A)
    t.check()
    with pytest.raises(ValueError):
        ts.Tensor(t.frame.where("d0 < 2"), t.shape).check()
    sparse = ts.from_sparse(spark.createDataFrame([(0, 1, 2.0), (0, 1, 3.0)], "i int, j int, x double"), ["i", "j"], "x", (2, 2))
    assert ts.to_numpy(sparse).tolist() == [[0.0, 5.0], [0.0, 0.0]]
    assert [r["v"] for r in t.packed().orderBy("d0").collect()] == A.tolist()


def test_running_sum(spark, tmp_path):
    from tessellum.streaming import running_sum

    ts.from_values(spark, A).frame.write.parquet(str(tmp_path / "in"))
    cells = spark.readStream.schema("d0 bigint, d1 bigint, v double").parquet(str(tmp_path / "in"))
    q = running_sum(cells, [1]).writeStream.outputMode("complete").format("memory").queryName("sums").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["d0"]: r["v"] for r in spark.table("sums").collect()}
    assert np.allclose([got[k] for k in range(4)], A.sum(0))


def test_logging(tmp_path):
    from tessellum.logs import set_logger_config

    log = set_logger_config("DEBUG", str(tmp_path / "log"), log_to_stdout=False, log_rank=True)
    log.debug("hello")
    set_logger_config(log_to_stdout=False)
    assert "[driver] DEBUG tessellum: hello" in (tmp_path / "log").read_text()


def test_slices_of_arrays_do_not_explode(spark):
    frame = spark.createDataFrame([(i, [float(i * 10 + j) for j in range(4)]) for i in range(3)], "r long, xs array<double>")
    t = ts.from_array_column(frame, "r", "xs", (3, 4))
    for code, want in (("R[i] = T[i,j]", [3.0, 13.0, 23.0]), ("R[i] = T[i,1]", [1.0, 11.0, 21.0])):
        out = ts.compile(code).execute({"T": t}, None, spark)["R"]
        assert ts.to_numpy(out).tolist() == want
        assert "Generate" not in out.frame._jdf.queryExecution().executedPlan().toString()
    assert ts.to_numpy(ts.compile("R[j] = T[1,j]").execute({"T": t}, None, spark)["R"]).tolist() == [10.0, 11.0, 12.0, 13.0]
