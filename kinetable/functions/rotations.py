"""Rotation algebra as Column builders.

A 3x3 matrix is an ``array<double>`` of nine values in row-major order. Builders
bind intermediate results with :func:`let`, so each matrix is computed once per row
even though several output elements use it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from kinetable.functions.vectors import dot, let, norm, slice_range, subtract

ZERO_NORM = 1e-8
IDENTITY9 = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
# No motion: zero translation and the identity rotation as two columns.
STILL_POSE9 = (0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0)


def doubles(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _e(m: Column, i: int) -> Column:
    return F.get(m, F.lit(i))


def transpose3(m: Column) -> Column:
    return F.array(*[_e(m, i) for i in (0, 3, 6, 1, 4, 7, 2, 5, 8)])


def matmul3(a: Column, b: Column) -> Column:
    """``a @ b``."""
    return F.array(
        *[
            _e(a, 3 * i) * _e(b, j) + _e(a, 3 * i + 1) * _e(b, 3 + j) + _e(a, 3 * i + 2) * _e(b, 6 + j)
            for i in range(3)
            for j in range(3)
        ]
    )


def relative3(a: Column, b: Column) -> Column:
    """``transpose(a) @ b``: rotation ``b`` seen from frame ``a``."""
    return F.array(
        *[
            _e(a, i) * _e(b, j) + _e(a, 3 + i) * _e(b, 3 + j) + _e(a, 6 + i) * _e(b, 6 + j)
            for i in range(3)
            for j in range(3)
        ]
    )


def rotate3(m: Column, v: Column, inverse: bool = False) -> Column:
    rows = [(0, 3, 6), (1, 4, 7), (2, 5, 8)] if inverse else [(0, 1, 2), (3, 4, 5), (6, 7, 8)]
    return F.array(*[sum((_e(m, k) * _e(v, n) for n, k in enumerate(r)), F.lit(0.0)) for r in rows])


def is_zero_quat(q: Column, eps: float = ZERO_NORM) -> Column:
    return norm(q) < F.lit(eps)


def valid_quat(q: Column, eps: float = ZERO_NORM) -> Column:
    """Quaternion guard: true when the norm is usable."""
    return norm(q) >= F.lit(eps)


def quat_to_mat(q: Column, order: str = "xyzw") -> Column:
    """Quaternion of any non-zero length to a matrix."""
    ix, iy, iz, iw = (0, 1, 2, 3) if order.lower() == "xyzw" else (1, 2, 3, 0)

    def build(v: Column) -> Column:
        x, y, z, w = _e(v, ix), _e(v, iy), _e(v, iz), _e(v, iw)
        k = F.lit(2.0) / (x * x + y * y + z * z + w * w)
        return let(
            k,
            lambda s: F.array(
                1.0 - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w),
                s * (x * y + z * w), 1.0 - s * (x * x + z * z), s * (y * z - x * w),
                s * (x * z - y * w), s * (y * z + x * w), 1.0 - s * (x * x + y * y),
            ),
        )

    return let(q, build)


def quat_to_mat_or_identity(q: Column, order: str = "xyzw") -> Column:
    return let(q, lambda v: F.when(is_zero_quat(v), doubles(IDENTITY9)).otherwise(quat_to_mat(v, order)))


def mat_to_quat(m: Column, order: str = "wxyz") -> Column:
    """Matrix to unit quaternion, choosing the numerically largest component."""

    def build(r: Column) -> Column:
        def pack(w, x, y, z):
            return F.array(w, x, y, z) if order == "wxyz" else F.array(x, y, z, w)

        xx, yy, zz = _e(r, 0), _e(r, 4), _e(r, 8)
        from_w = let(
            F.sqrt(F.greatest(1.0 + xx + yy + zz, F.lit(0.0))) * 2.0,
            lambda s: pack(s / 4.0, (_e(r, 7) - _e(r, 5)) / s, (_e(r, 2) - _e(r, 6)) / s, (_e(r, 3) - _e(r, 1)) / s),
        )
        from_x = let(
            F.sqrt(F.greatest(1.0 + xx - yy - zz, F.lit(0.0))) * 2.0,
            lambda s: pack((_e(r, 7) - _e(r, 5)) / s, s / 4.0, (_e(r, 1) + _e(r, 3)) / s, (_e(r, 2) + _e(r, 6)) / s),
        )
        from_y = let(
            F.sqrt(F.greatest(1.0 + yy - xx - zz, F.lit(0.0))) * 2.0,
            lambda s: pack((_e(r, 2) - _e(r, 6)) / s, (_e(r, 1) + _e(r, 3)) / s, s / 4.0, (_e(r, 5) + _e(r, 7)) / s),
        )
        from_z = let(
            F.sqrt(F.greatest(1.0 + zz - xx - yy, F.lit(0.0))) * 2.0,
            lambda s: pack((_e(r, 3) - _e(r, 1)) / s, (_e(r, 2) + _e(r, 6)) / s, (_e(r, 5) + _e(r, 7)) / s, s / 4.0),
        )
        return (
            F.when(xx + yy + zz > 0, from_w)
            .when((xx > yy) & (xx > zz), from_x)
            .when(yy > zz, from_y)
            .otherwise(from_z)
        )

    return let(m, build)


def euler_to_mat(e: Column) -> Column:
    """Extrinsic x-y-z angles: ``Rz @ Ry @ Rx``."""

    def build(v: Column) -> Column:
        trig = F.array(
            F.cos(_e(v, 0)), F.sin(_e(v, 0)), F.cos(_e(v, 1)), F.sin(_e(v, 1)), F.cos(_e(v, 2)), F.sin(_e(v, 2))
        )

        def fill(t: Column) -> Column:
            ca, sa, cb, sb, cc, sc = (_e(t, i) for i in range(6))
            return F.array(
                cc * cb, cc * sb * sa - sc * ca, cc * sb * ca + sc * sa,
                sc * cb, sc * sb * sa + cc * ca, sc * sb * ca - cc * sa,
                -sb, cb * sa, cb * ca,
            )

        return let(trig, fill)

    return let(e, build)


def mat_to_euler(m: Column) -> Column:
    """Inverse of :func:`euler_to_mat`; gimbal lock sets the last angle to zero."""

    def build(r: Column) -> Column:
        sy = F.sqrt(_e(r, 0) * _e(r, 0) + _e(r, 3) * _e(r, 3))
        regular = F.array(F.atan2(_e(r, 7), _e(r, 8)), F.atan2(-_e(r, 6), sy), F.atan2(_e(r, 3), _e(r, 0)))
        locked = F.array(F.atan2(-_e(r, 5), _e(r, 4)), F.atan2(-_e(r, 6), sy), F.lit(0.0))
        return F.when(sy >= 1e-6, regular).otherwise(locked)

    return let(m, build)


def _unit(v: Column, eps: float = 0.0, floor: float = 0.0) -> Column:
    length = norm(v) + eps if eps else F.greatest(norm(v), F.lit(floor)) if floor else norm(v)
    return let(length, lambda n: F.transform(v, lambda x: x / n))


def _cross(a: Column, b: Column) -> Column:
    return F.array(
        _e(a, 1) * _e(b, 2) - _e(a, 2) * _e(b, 1),
        _e(a, 2) * _e(b, 0) - _e(a, 0) * _e(b, 2),
        _e(a, 0) * _e(b, 1) - _e(a, 1) * _e(b, 0),
    )


def _orthonormal(first: Column, second: Column, assemble, eps: float = 0.0) -> Column:
    floor = 0.0 if eps else ZERO_NORM

    def with_u(u: Column) -> Column:
        def with_v(v: Column) -> Column:
            return let(_cross(u, v), lambda w: assemble(u, v, w))

        rejected = let(dot(u, second), lambda d: F.zip_with(second, u, lambda s, x: s - d * x))
        return let(_unit(rejected, eps, floor), with_v)

    return let(_unit(first, eps, floor), with_u)


def rot6d_to_mat(c: Column) -> Column:
    """First two matrix COLUMNS (Gram-Schmidt) to a matrix."""

    def columns(u: Column, v: Column, w: Column) -> Column:
        return F.array(*[_e(k, i) for i in range(3) for k in (u, v, w)])

    return let(c, lambda r: _orthonormal(F.slice(r, 1, 3), F.slice(r, 4, 3), columns))


def mat_to_rot6d(m: Column) -> Column:
    return let(m, lambda r: F.array(*[_e(r, i) for i in (0, 3, 6, 1, 4, 7)]))


def rot6d_rows_to_mat(c: Column) -> Column:
    """First two matrix ROWS (Gram-Schmidt) to a matrix, the dual-arm convention."""
    return let(
        c, lambda r: _orthonormal(F.slice(r, 1, 3), F.slice(r, 4, 3), lambda u, v, w: F.concat(u, v, w), 1e-8)
    )


def mat_to_rotvec(m: Column) -> Column:
    """Axis times angle, through the quaternion so that half turns stay stable."""

    def build(q: Column) -> Column:
        s = F.sqrt(_e(q, 1) * _e(q, 1) + _e(q, 2) * _e(q, 2) + _e(q, 3) * _e(q, 3))
        sign = F.when(_e(q, 0) < 0, -1.0).otherwise(1.0)
        # angle / sin(angle / 2) tends to 2 for tiny rotations
        k = let(s, lambda n: F.when(n < 1e-12, F.lit(2.0)).otherwise(2.0 * F.atan2(n, F.abs(_e(q, 0))) / n))
        return let(k * sign, lambda f: F.array(_e(q, 1) * f, _e(q, 2) * f, _e(q, 3) * f))

    return let(mat_to_quat(m, "wxyz"), build)


def rotvec_to_mat(v: Column) -> Column:
    def build(r: Column) -> Column:
        def fill(t: Column) -> Column:
            half = t / 2.0
            k = F.when(t < 1e-12, F.lit(0.5)).otherwise(F.sin(half) / t)
            return quat_to_mat(F.array(_e(r, 0) * k, _e(r, 1) * k, _e(r, 2) * k, F.cos(half)))

        return let(norm(r), fill)

    return let(v, build)


def rotation_of(pose: Column, fmt: str, order: str = "xyzw", start: int = 3) -> Column:
    """Matrix of the rotation part of a pose ``[x, y, z, rotation...]``."""
    if fmt == "quat":
        return quat_to_mat_or_identity(F.slice(pose, start + 1, 4), order)
    if fmt == "euler":
        return euler_to_mat(F.slice(pose, start + 1, 3))
    if fmt == "rot6d":
        return rot6d_to_mat(F.slice(pose, start + 1, 6))
    raise ValueError(f"unknown rotation format {fmt!r}")


def hybrid_relative_step(
    action: Column,
    ref: Column,
    ref_rot: Column,
    in_fmt: str = "quat",
    in_order: str = "xyzw",
) -> Column:
    """One pose against an already converted reference: 3 offsets + 6 rotation values.

    A zero-norm action quaternion yields "no motion".
    """

    def build(a: Column) -> Column:
        offset = subtract(F.slice(a, 1, 3), F.slice(ref, 1, 3))
        moved = F.concat(offset, mat_to_rot6d(let(rotation_of(a, in_fmt, in_order), lambda r: relative3(ref_rot, r))))
        if in_fmt != "quat":
            return moved
        return F.when(is_zero_quat(F.slice(a, 4, 4)), doubles(STILL_POSE9)).otherwise(moved)

    return let(action, build)


def hybrid_relative(
    actions: Column,
    ref: Column,
    in_fmt: str = "quat",
    ref_fmt: str = "quat",
    in_order: str = "xyzw",
    ref_order: str = "xyzw",
) -> Column:
    """Window of absolute poses to offsets relative to one reference pose."""
    return let(
        rotation_of(ref, ref_fmt, ref_order),
        lambda rr: F.transform(actions, lambda a: hybrid_relative_step(a, ref, rr, in_fmt, in_order)),
    )


def engaged_delta(
    actions: Column,
    ref: Column,
    engaged: Column,
    ref_engaged: Column,
    in_fmt: str = "rot6d",
    ref_fmt: str = "rot6d",
) -> Column:
    """Re-integrate only the motion made while engaged at both ends of a step."""

    def step(acc: Column, t: Column) -> Column:
        pose = F.get(actions, t)
        on = F.get(engaged, t)
        rot = rotation_of(pose, in_fmt)

        def advance(r: Column) -> Column:
            live = acc["on"] & on
            moved = F.zip_with(
                acc["xyz"], subtract(F.slice(pose, 1, 3), acc["prev_xyz"]), lambda s, d: s + d
            )
            turned = let(relative3(acc["prev_rot"], r), lambda d: matmul3(acc["rot"], d))
            xyz = F.when(live, moved).otherwise(acc["xyz"])
            total = F.when(live, turned).otherwise(acc["rot"])
            return F.struct(
                xyz.alias("xyz"),
                total.alias("rot"),
                F.slice(pose, 1, 3).alias("prev_xyz"),
                r.alias("prev_rot"),
                on.alias("on"),
                F.concat(
                    acc["out"], F.array(F.concat(xyz, mat_to_rot6d(total)))
                ).alias("out"),
            )

        return let(rot, advance)

    start = F.struct(
        doubles((0, 0, 0)).alias("xyz"),
        doubles(IDENTITY9).alias("rot"),
        F.slice(ref, 1, 3).alias("prev_xyz"),
        rotation_of(ref, ref_fmt).alias("prev_rot"),
        ref_engaged.alias("on"),
        F.slice(actions, 1, 0).alias("out"),
    )
    return F.aggregate(F.sequence(F.lit(0), F.size(actions) - 1), start, step, lambda a: a["out"])


def scale_motion(rel: Column, translation: float | Column, rotation: float | Column) -> Column:
    """Scale a 9-value relative pose: offsets by a factor, rotation by its angle."""
    t = F.lit(translation) if not isinstance(translation, Column) else translation
    k = F.lit(rotation) if not isinstance(rotation, Column) else rotation

    def build(p: Column) -> Column:
        turned = let(
            mat_to_rotvec(rot6d_to_mat(F.slice(p, 4, 6))),
            lambda v: F.when(norm(v) > ZERO_NORM, F.transform(v, lambda x: x * k)).otherwise(v),
        )
        return F.concat(F.transform(F.slice(p, 1, 3), lambda x: x * t), mat_to_rot6d(rotvec_to_mat(turned)))

    return let(rel, build)


def dual_arm_relative(actions: Column) -> Column:
    """``T x 20`` dual-arm actions to ``(T-1) x 20`` relative to step 0 (row convention)."""

    def arm(pose: Column, base: Column, base_rot: Column, at: int) -> Column:
        offset = subtract(F.slice(pose, at + 1, 3), F.slice(base, at + 1, 3))
        rot = let(
            rot6d_rows_to_mat(F.slice(pose, at + 4, 6)),
            lambda r: F.slice(relative3(base_rot, r), 1, 6),
        )
        return F.concat(offset, rot, F.slice(pose, at + 10, 1))

    def with_base(base: Column) -> Column:
        return let(
            rot6d_rows_to_mat(F.slice(base, 4, 6)),
            lambda r0: let(
                rot6d_rows_to_mat(F.slice(base, 14, 6)),
                lambda r1: F.transform(
                    F.slice(actions, F.lit(2), F.greatest(F.size(actions) - 1, F.lit(0))),
                    lambda p: F.concat(arm(p, base, r0, 0), arm(p, base, r1, 10)),
                ),
            ),
        )

    return let(F.get(actions, F.lit(0)), with_base)


def pose_step(base: Column, cur: Column) -> Column:
    """Motion between two ``[xyz, euler]`` poses, in the base frame: 3 offsets + 3 angles."""

    def build(rb: Column) -> Column:
        offset = rotate3(rb, subtract(F.slice(cur, 1, 3), F.slice(base, 1, 3)), inverse=True)
        turn = mat_to_euler(let(euler_to_mat(F.slice(cur, 4, 3)), lambda rc: relative3(rb, rc)))
        return F.concat(offset, turn)

    return let(euler_to_mat(F.slice(base, 4, 3)), build)
