"""Convergence, tree and minima reports as text, one file each: their rows are as few as steps, coordinates or torsions.

The layout is fixed: cells are parted by a comma and a space and padded on the right.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters of types in tree reports.
LETTER = {"bond": "B", "angle": "A", "torsion": "T"}


#: Heads of the columns whose names here have no slash or hyphen.
HEADS = {"TIME": "TIME", "BOND_S1": "BOND-S1", "ANGLE_S1": "ANGLE-S1", "DIHED_S1": "DIHED-S1", "S1": "S1", "S2": "S2"}


def write_file(spark: SparkSession, path: str, lines: list[str], overwrite: bool = False) -> None:
    """One file of these lines, in whatever store the path names; one that exists is not overwritten unless asked for."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, overwrite)
    try:
        out.write(bytearray("".join(f"{x}\n" for x in lines).encode()))
    finally:
        out.close()


def convergence_lines(columns: list[str], rows: list) -> list[str]:
    """18 columns of width 13, numbers with 4 decimals but for the time."""
    heads = [HEADS.get(c) or f"{c[0]}/{c[1]}-{c[3:]}" for c in columns]
    cells = [[str(r[c]) if c == "TIME" else f"{r[c]:.4f}" for c in columns] for r in rows]
    return [", ".join(x.ljust(13) for x in line) for line in [heads, *cells]]


def tree_lines(rows: list) -> list[str]:
    """Types as letters of width 3, numbers of width 9, informations with 6 decimals."""
    body = [f"{LETTER[r['t1']]:<3}, {LETTER[r['t2']]:<3}, {r['d1']:<9}, {r['d2']:<9}, {r['mi']:<3.6f}" for r in rows]
    return ["TD1, TD2, IndexDim1, IndexDim2, MI", *body]


def minima_lines(rows: list) -> list[str]:
    """A torsion's number in width 6 on the right, how many minima, and each with 8 decimals."""
    return [" ".join([f"torsion {r['dof']:>6} {r['k']}", *(f"{m:.8f}" for m in r["minima"])]) + ";" for r in rows]


def write_convergence(report: DataFrame, path: str) -> None:
    """Rows by step."""
    columns = [c for c in report.columns if c not in ("estimator", "scheme", "step")]
    write_file(report.sparkSession, path, convergence_lines(columns, report.orderBy("step").collect()))


def write_tree(edges: DataFrame, path: str) -> None:
    """Edges by falling information: one less than there are coordinates at most."""
    write_file(edges.sparkSession, path, tree_lines(edges.orderBy(F.desc("mi"), "t1", "d1", "t2", "d2").collect()))


def write_minima(found: DataFrame, path: str) -> None:
    """A line a torsion."""
    write_file(found.sparkSession, path, minima_lines(found.orderBy("dof").collect()))
