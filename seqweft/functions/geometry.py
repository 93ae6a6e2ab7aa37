"""Orientation and vector expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed value: standard gravity as the sensor data use it
GRAVITY = 9.81

QUATERNION = ("rot_w", "rot_x", "rot_y", "rot_z")
ACCELERATION = ("acc_x", "acc_y", "acc_z")


def rotation_rows(w: Column, x: Column, y: Column, z: Column) -> list[list[Column]]:
    """Rotation matrix of a quaternion as nine expressions; the quaternion is used as it is."""

    def diagonal(a: Column, b: Column) -> Column:
        return 1 - 2 * (a * a + b * b)

    def off(a: Column, b: Column, turn: Column) -> Column:
        return 2 * (a * b + turn)

    return [
        [diagonal(y, z), off(x, y, -z * w), off(x, z, y * w)],
        [off(x, y, z * w), diagonal(x, z), off(y, z, -x * w)],
        [off(x, z, -y * w), off(y, z, x * w), diagonal(x, y)],
    ]


def rotation_matrix(df: DataFrame, name: str = "rotation", quaternion=QUATERNION) -> DataFrame:
    rows = rotation_rows(*[F.col(c) for c in quaternion])
    return df.withColumn(name, F.array(*[F.array(*row) for row in rows]))


def world_frame(
    df: DataFrame, acceleration=ACCELERATION, quaternion=QUATERNION, gravity: float = GRAVITY
) -> DataFrame:
    """Adds `acc_w_*`, acceleration turned into the world frame, and `lin_acc_*`, the same less gravity.

    A narrow projection: each row carries its own orientation, so nothing is grouped or shuffled.
    """
    rows = rotation_rows(*[F.col(c) for c in quaternion])
    vector = [F.col(c) for c in acceleration]
    world = {f"acc_w_{axis}": sum((m * v for m, v in zip(row[1:], vector[1:])), row[0] * vector[0]) for axis, row in zip("xyz", rows)}
    out = df.withColumns(world)
    pull = {"x": 0.0, "y": 0.0, "z": gravity}
    return out.withColumns({f"lin_acc_{axis}": F.col(f"acc_w_{axis}") - pull[axis] for axis in "xyz"})


def magnitude(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)
