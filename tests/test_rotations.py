"""Rotation builders against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.functions import rotations as R

RNG = np.random.default_rng(7)


def quat_mat(q):
    x, y, z, w = q / np.linalg.norm(q)
    return np.array([
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ])


def six(m):
    return m[:, :2].T.ravel()


def run(spark, values, build):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(values)], "id int, v array<double>")
    return [np.array(r[1]) for r in df.select("id", build(F.col("v"))).orderBy("id").collect()]


def test_quaternion_orders(spark):
    qs = RNG.normal(size=(20, 4))
    for got, q in zip(run(spark, qs, R.quat_to_mat), qs):
        np.testing.assert_allclose(got.reshape(3, 3), quat_mat(q), atol=1e-12)
    swapped = qs[:, [3, 0, 1, 2]]
    for got, q in zip(run(spark, swapped, lambda c: R.quat_to_mat(c, "wxyz")), qs):
        np.testing.assert_allclose(got.reshape(3, 3), quat_mat(q), atol=1e-12)


def test_matrix_to_quaternion_covers_every_branch(spark):
    axes = np.vstack([np.eye(4), -np.eye(4), RNG.normal(size=(30, 4))])
    for got, q in zip(run(spark, axes, lambda c: R.mat_to_quat(R.quat_to_mat(c), "xyzw")), axes):
        unit = q / np.linalg.norm(q)
        assert min(np.abs(got - unit).max(), np.abs(got + unit).max()) < 1e-9


def test_rot6d_round_trip(spark):
    qs = RNG.normal(size=(20, 4))
    for got, q in zip(run(spark, qs, lambda c: R.rot6d_to_mat(R.mat_to_rot6d(R.quat_to_mat(c)))), qs):
        np.testing.assert_allclose(got.reshape(3, 3), quat_mat(q), atol=1e-9)


def test_euler_round_trip_and_gimbal_lock(spark):
    es = RNG.uniform(-1.4, 1.4, size=(20, 3))
    for got, e in zip(run(spark, es, lambda c: R.mat_to_euler(R.euler_to_mat(c))), es):
        np.testing.assert_allclose(got, e, atol=1e-9)
    locked = run(spark, [[0.3, np.pi / 2, 0.2]], lambda c: R.euler_to_mat(R.mat_to_euler(R.euler_to_mat(c))))[0]
    want = run(spark, [[0.3, np.pi / 2, 0.2]], R.euler_to_mat)[0]
    np.testing.assert_allclose(locked, want, atol=1e-6)


def test_rotation_vector_round_trip(spark):
    vs = np.vstack([RNG.normal(size=(20, 3)), np.zeros((1, 3)), [[1e-10, 0, 0]], [[np.pi - 1e-4, 0, 0]]])
    for got, v in zip(run(spark, vs, lambda c: R.mat_to_rotvec(R.rotvec_to_mat(c))), vs):
        angle = np.linalg.norm(v)
        want = v if angle <= np.pi else v / angle * (angle - 2 * np.pi)
        np.testing.assert_allclose(got, want, atol=1e-7)


def test_zero_quaternions(spark):
    raw = [(0, [1, 2, 3, 0, 0, 0, 0], [0.5, 0, 0, 0, 0, 0, 1]), (1, [1, 2, 3, 0, 0, 0, 2], [0.5, 0, 0, 0, 0, 0, 0])]
    rows = [(i, [[float(x) for x in a]], [float(x) for x in r]) for i, a, r in raw]
    df = spark.createDataFrame(rows, "id int, a array<array<double>>, r array<double>")
    out = [r[0][0] for r in df.orderBy("id").select(R.hybrid_relative(F.col("a"), F.col("r"))).collect()]
    assert out[0] == list(R.STILL_POSE9)
    assert out[1] == [0.5, 2.0, 3.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0]


@pytest.mark.parametrize("in_fmt", ["rot6d", "quat"])
def test_engaged_delta(spark, in_fmt):
    rows, want = [], []
    for i in range(15):
        qs, xyz = RNG.normal(size=(7, 4)), RNG.normal(size=(7, 3))
        mats = [quat_mat(q) for q in qs]
        on = (RNG.random(7) > 0.35).tolist()
        pose = lambda k: [*xyz[k], *(six(mats[k]) if in_fmt == "rot6d" else qs[k])]
        rows.append((i, [[float(x) for x in pose(k)] for k in range(1, 7)], [float(x) for x in pose(0)], on[1:], on[0]))
        pos, rot, out = np.zeros(3), np.eye(3), []
        for k in range(1, 7):
            if on[k] and on[k - 1]:
                pos, rot = pos + xyz[k] - xyz[k - 1], rot @ (mats[k - 1].T @ mats[k])
            out.append([*pos, *six(rot)])
        want.append(out)
    df = spark.createDataFrame(rows, "id int, a array<array<double>>, r array<double>, e array<boolean>, e0 boolean")
    col = R.engaged_delta(F.col("a"), F.col("r"), F.col("e"), F.col("e0"), in_fmt, in_fmt)
    got = [r[0] for r in df.orderBy("id").select(col).collect()]
    np.testing.assert_allclose(np.array(got), np.array(want), atol=1e-9)


def test_scale_motion_halves_the_angle(spark):
    v = np.array([0.4, -0.6, 0.2])
    rel = run(spark, [v], lambda c: F.concat(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), R.mat_to_rot6d(R.rotvec_to_mat(c))))
    got = run(spark, rel, lambda c: R.scale_motion(c, 0.5, 0.5))[0]
    want = run(spark, [v / 2], lambda c: R.mat_to_rot6d(R.rotvec_to_mat(c)))[0]
    np.testing.assert_allclose(got, [0.5, 1.0, 1.5, *want], atol=1e-9)
