"""Fitting, periodic boxes, electrostatics, elastic networks and Langevin dynamics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spatial
from . import vectors as V

COULOMB = 332.0636


def rmsd_by_frame(frames: DataFrame, reference: DataFrame) -> DataFrame:
    """(frame, n, rmsd) against reference coordinates, without fitting."""
    ref = reference.select("atom", *(F.col(c).cast("double").alias(f"r{c}") for c in "xyz"))
    d = V.sub(V.vec(), V.vec("r"))
    return frames.join(ref, "atom").groupBy("frame").agg(F.count("*").alias("n"), F.sqrt(F.avg(V.dot(d, d))).alias("rmsd"))


def scatter_sums(frames: DataFrame, reference: DataFrame) -> DataFrame:
    """Sums per frame from which centroids and the 3 x 3 covariance follow; partially combined."""
    ref = reference.select("atom", *(F.col(c).cast("double").alias(f"r{c}") for c in "xyz"))
    rows = frames.join(ref, "atom")
    one = [F.sum(F.col(f"{p}{c}").cast("double")).alias(f"s{p}{c}") for p in ("", "r") for c in "xyz"]
    two = [F.sum(F.col(a).cast("double") * F.col(f"r{b}")).alias(f"p{a}{b}") for a in "xyz" for b in "xyz"]
    norm = [F.sum(V.dot(V.vec(p), V.vec(p))).alias(f"q{p}") for p in ("", "r")]
    return rows.groupBy("frame").agg(F.count("*").alias("n"), *one, *two, *norm)


def fit_kabsch(frames: DataFrame, reference: DataFrame, translate: bool = True) -> DataFrame:
    """(frame, n, rmsd, matrix): the best rigid map of each frame onto the reference.

    Only sums reach the kernel: one row per frame.  Collinear frames get the identity rotation.
    """

    def solve(row: pd.Series) -> tuple[float, list[float]]:
        n = row["n"]
        a = np.array([row[f"s{c}"] for c in "xyz"]) / n
        b = np.array([row[f"sr{c}"] for c in "xyz"]) / n
        if not translate:
            a, b = np.zeros(3), np.zeros(3)
        h = np.array([[row[f"p{p}{q}"] for q in "xyz"] for p in "xyz"]) - n * np.outer(a, b)
        k = np.zeros((4, 4))
        k[0, 0] = np.trace(h)
        k[0, 1:] = k[1:, 0] = [h[1, 2] - h[2, 1], h[2, 0] - h[0, 2], h[0, 1] - h[1, 0]]
        k[1:, 1:] = h + h.T - np.trace(h) * np.eye(3)
        values, vectors = np.linalg.eigh(k)
        w, x, y, z = vectors[:, -1] if np.linalg.matrix_rank(h, tol=1e-9 * max(1.0, abs(h).max())) >= 2 else (1, 0, 0, 0)
        r = np.array([[w * w + x * x - y * y - z * z, 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z]])
        size = row["q"] - n * (a @ a) + row["qr"] - n * (b @ b)
        t = b - r @ a
        m = np.eye(4)
        m[:3, :3], m[:3, 3] = r, t
        return math.sqrt(max(0.0, (size - 2 * float((r.T * h).sum())) / n)), m.T.reshape(-1).tolist()

    def run(tables):
        for table in tables:
            found = [solve(row) for _, row in table.iterrows()]
            yield pd.DataFrame({"frame": table["frame"], "n": table["n"], "rmsd": [f[0] for f in found], "matrix": [f[1] for f in found]})

    return scatter_sums(frames, reference).mapInPandas(run, "frame int, n long, rmsd double, matrix array<double>")


def superposed(frames: DataFrame, reference: DataFrame) -> DataFrame:
    fits = fit_kabsch(frames, reference).select("frame", "matrix")
    moved = V.affine_column(F.col("matrix"), V.vec())
    out = frames.join(fits, "frame")
    return out.withColumns({c: v.cast("float") for c, v in zip("xyz", moved)}).drop("matrix")


def box_matrix(a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column) -> Column:
    """Cell lengths and angles (degrees) -> nine values, column-major."""
    ca, cb, cg, sg = F.cos(F.radians(alpha)), F.cos(F.radians(beta)), F.cos(F.radians(gamma)), F.sin(F.radians(gamma))
    cy = c * (ca - cb * cg) / sg
    cz = F.sqrt(F.greatest(F.lit(0.0), c * c - c * c * cb * cb - cy * cy))
    zero = F.lit(0.0)
    return F.array(a, zero, zero, b * cg, b * sg, zero, c * cb, cy, cz)


def minimum_image_triclinic(d: np.ndarray, box: np.ndarray, most: int = 1_000_000) -> np.ndarray:
    """Shortest lattice images of differences (n, 3); rows of ``box`` are lattice vectors.

    The nearest of the 27 images around the rounded one bounds how far another can be; all
    within that bound are tried, and of equally near ones the least lattice vector counts.
    """
    inverse = np.linalg.inv(box)
    frac = d @ inverse
    seed = np.floor(frac + 0.5)
    around = np.array([(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)], float)
    near = (((d - seed @ box)[:, None, :] - (around @ box)[None]) ** 2).sum(2).min(1)
    radius = np.sqrt(near) * np.linalg.norm(inverse) + 1e-9
    out = np.empty_like(d)
    for i in range(len(d)):
        low, high = np.ceil(frac[i] - radius[i]), np.floor(frac[i] + radius[i])
        if np.prod(high - low + 1) > most:
            raise ValueError("the box is too skew: too many images to try")
        shifts = np.stack(np.meshgrid(*(np.arange(a, b + 1) for a, b in zip(low, high)), indexing="ij"), axis=-1).reshape(-1, 3)
        every = d[i] - shifts @ box
        squared = (every**2).sum(1)
        out[i] = every[int(np.argmax(squared <= squared.min() + 1e-12 * max(squared.min(), 1e-30)))]
    return out


def unwrap(frames: DataFrame, tree: DataFrame, boxes: DataFrame) -> DataFrame:
    """Place each atom at the image nearest its parent's, along a spanning tree per component.

    tree: (atom, parent, depth, component), parent null at roots; boxes: (frame, box of nine).
    """

    def place(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["depth", "atom"], ignore_index=True)
        box = np.array(table["box"].iat[0], float).reshape(3, 3)
        xyz = table[["x", "y", "z"]].to_numpy(float)
        where = {a: i for i, a in enumerate(table["atom"])}
        for depth in sorted(table["depth"].unique()):
            rows = np.flatnonzero((table["depth"] == depth).to_numpy() & table["parent"].notna().to_numpy())
            rows = rows[[table["parent"].iat[i] in where for i in rows]] if len(rows) else rows
            if len(rows):
                base = xyz[[where[int(table["parent"].iat[i])] for i in rows]]
                xyz[rows] = base + minimum_image_triclinic(xyz[rows] - base, box)
        return pd.DataFrame({"frame": table["frame"], "atom": table["atom"], "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})

    rows = frames.select("frame", "atom", "x", "y", "z").join(tree, "atom").join(boxes, "frame")
    return rows.groupBy("frame", "component").applyInPandas(place, "frame int, atom long, x double, y double, z double")


def spanning_tree(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(atom, parent, depth, component): breadth-first from the least atom of each component."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    rows = parts.join(both.groupBy(F.col("a").alias("node")).agg(F.sort_array(F.collect_list("b")).alias("next")), "node", "left")

    def walk(table: pd.DataFrame) -> pd.DataFrame:
        nexts = {int(n): ([] if x is None else [int(v) for v in x]) for n, x in zip(table["node"], table["next"])}
        root = min(nexts)
        parent, depth, queue = {root: None}, {root: 0}, [root]
        for n in queue:
            for b in nexts[n]:
                if b not in parent:
                    parent[b], depth[b] = n, depth[n] + 1
                    queue.append(b)
        return pd.DataFrame({"atom": queue, "parent": pd.array([parent[n] for n in queue], "Int64"), "depth": [depth[n] for n in queue], "component": int(table["component"].iat[0])})

    return rows.groupBy("component").applyInPandas(walk, "atom long, parent long, depth int, component long")


def coulomb_kernel(d2: Column, model: str = "vacuum", dielectric: float = 1.0, kappa: float = 0.0, least: float = 1.0) -> Column:
    """Potential of a unit charge at a squared distance: vacuum, distance-dependent or Debye."""
    r = F.sqrt(F.greatest(d2, F.lit(least * least)))
    if model == "vacuum":
        return F.lit(COULOMB / dielectric) / r
    if model == "distance":
        return F.lit(COULOMB / dielectric) / (r * r)
    return F.lit(COULOMB / dielectric) * F.exp(-F.lit(kappa) * r) / r


def debye_kappa(ionic_strength: float, dielectric: float = 78.5, temperature: float = 298.15) -> float:
    """Inverse Debye length in 1/A for a 1:1 salt (mol/l)."""
    e, kb, na, eps0 = 1.602176634e-19, 1.380649e-23, 6.02214076e23, 8.8541878128e-12
    return math.sqrt(2 * na * e * e * ionic_strength * 1000 / (eps0 * dielectric * kb * temperature)) * 1e-10


def coulomb_switch(r: Column, cutoff: float, width: float) -> Column:
    """1 up to cutoff - width, then smoothly to 0 at the cutoff."""
    return F.lit(1.0) - V.smoothstep(cutoff - width, cutoff, r)


def coulomb_potential(points: DataFrame, charges: DataFrame, cutoff: float | None = None, **kernel) -> DataFrame:
    """(point, phi): the potential of all charges at each point.

    With a cutoff a spatial join pairs points and charges; without one every charge counts and
    the charges, checked to be few, are sent to every task.
    """
    q = charges.filter("q <> 0").select("q", *(F.col(c).cast("double") for c in "xyz"))
    if cutoff is not None:
        pairs = spatial.near_pairs(points.select("point", "x", "y", "z"), q, cutoff)
        phi = F.col("r_q") * coulomb_kernel(F.col("d2"), **kernel)
        found = pairs.groupBy(F.col("l_point").alias("point")).agg(F.sum(phi).alias("phi"))
        return points.select("point").join(found, "point", "left").select("point", F.coalesce("phi", F.lit(0.0)).alias("phi"))
    if q.count() > 2_000_000:
        raise spatial.PairLimitError("too many charges for an exact sum; give a cutoff")
    both = points.select("point", "x", "y", "z").alias("l").crossJoin(F.broadcast(q).alias("r"))
    phi = F.col("r.q") * coulomb_kernel(spatial.squared_distance("l", "r"), **kernel)
    return both.groupBy("point").agg(F.sum(phi).alias("phi"))


def elastic_pairs(nodes: DataFrame, cutoff: float) -> DataFrame:
    """(a, b, ux, uy, uz): contacts of guide atoms with unit directions."""
    rows = nodes.select("atom", "x", "y", "z")
    pairs = spatial.near_pairs(rows, rows, cutoff, F.col("l.atom") < F.col("r.atom"))
    d = F.sqrt("d2")
    u = {f"u{c}": (F.col(f"r_{c}").cast("double") - F.col(f"l_{c}").cast("double")) / F.when(d > 0, d) for c in "xyz"}
    return pairs.select(F.col("l_atom").alias("a"), F.col("r_atom").alias("b"), *(v.alias(k) for k, v in u.items()))


def elastic_modes(nodes: DataFrame, cutoff: float, kind: str = "gnm", count: int = 10, most: int = 6_000) -> DataFrame:
    """(mode, eigenvalue, atom, vx, vy, vz) of the first non-zero modes; one dense task.

    Modes are a global property of one structure's guide atoms; more than ``most`` are refused.
    """
    if nodes.count() > most:
        raise spatial.PairLimitError(f"more than {most} nodes")
    pairs = elastic_pairs(nodes, cutoff)
    order = nodes.select("atom").withColumn("g", F.lit(0))
    edges = pairs.withColumn("g", F.lit(0))

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        atoms = np.sort(left["atom"].to_numpy())
        at, n = {a: i for i, a in enumerate(atoms)}, len(atoms)
        dims = 1 if kind == "gnm" else 3
        h = np.zeros((n * dims, n * dims))
        for a, b, x, y, z in zip(right["a"], right["b"], right["ux"], right["uy"], right["uz"]):
            i, j = at[a], at[b]
            u = np.array([[1.0]]) if dims == 1 else np.outer((x, y, z), (x, y, z))
            si, sj = slice(i * dims, i * dims + dims), slice(j * dims, j * dims + dims)
            h[si, si] += u
            h[sj, sj] += u
            h[si, sj] -= u
            h[sj, si] -= u
        values, vectors = np.linalg.eigh(h)
        first = np.flatnonzero(values > 1e-6)[:count]
        out = []
        for m, k in enumerate(first):
            v = vectors[:, k].reshape(n, dims)
            v = v * (1 if v.flat[np.abs(v).argmax()] > 0 else -1)
            full = np.zeros((n, 3))
            full[:, :dims] = v
            out.append(pd.DataFrame({"mode": m, "eigenvalue": values[k], "atom": atoms, "vx": full[:, 0], "vy": full[:, 1], "vz": full[:, 2]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["mode", "eigenvalue", "atom", "vx", "vy", "vz"])

    return order.groupBy("g").cogroup(edges.groupBy("g")).applyInPandas(solve, "mode int, eigenvalue double, atom long, vx double, vy double, vz double")


def apply_mode(atoms: DataFrame, mode: DataFrame, amplitude: float, phase: float) -> DataFrame:
    """Coordinates displaced along a mode (atom, vx, vy, vz)."""
    k = F.lit(amplitude * math.sin(phase))
    out = atoms.join(mode.select("atom", "vx", "vy", "vz"), "atom", "left")
    return out.withColumns({c: (F.col(c).cast("double") + k * F.coalesce(f"v{c}", F.lit(0.0))).cast("float") for c in "xyz"}).drop("vx", "vy", "vz")


def philox(counter: np.ndarray, key: tuple[int, int]) -> np.ndarray:
    """Philox 4x32-10: (n, 4) counters -> (n, 4) random words."""
    c = counter.astype(np.uint64).copy()
    k0, k1, mask = np.uint64(key[0]), np.uint64(key[1]), np.uint64(0xFFFFFFFF)
    for _ in range(10):
        p0, p1 = c[:, 0] * np.uint64(0xD2511F53), c[:, 2] * np.uint64(0xCD9E8D57)
        c = np.stack([(p1 >> np.uint64(32)) ^ c[:, 1] ^ k0, p1 & mask, (p0 >> np.uint64(32)) ^ c[:, 3] ^ k1, p0 & mask], axis=1)
        k0, k1 = (k0 + np.uint64(0x9E3779B9)) & mask, (k1 + np.uint64(0xBB67AE85)) & mask
    return c


# Coefficients of the single-precision inverse error function, highest power first.
ERFINV_CENTRE = (2.81022636e-08, 3.43273939e-07, -3.5233877e-06, -4.39150654e-06, 0.00021858087, -0.00125372503, -0.00417768164, 0.246640727, 1.50140941)
ERFINV_TAIL = (-0.000200214257, 0.000100950558, 0.00134934322, -0.00367342844, 0.00573950773, -0.0076224613, 0.00943887047, 1.00167406, 2.83297682)


def word_normals(words: np.ndarray) -> np.ndarray:
    """Standard normals of 32-bit words by the inverse error function, in single precision."""
    f = np.float32
    u = ((words.astype(np.uint64) >> np.uint64(9)).astype(float) + 0.5) * 2.0**-23
    u = u.astype(f)
    x = f(2) * u - f(1)
    w = -np.log((f(4) * u * (f(1) - u)).astype(float)).astype(f)

    def horner(coefficients, at):
        out = np.full_like(at, f(coefficients[0]))
        for c in coefficients[1:]:
            out = f(c) + out * at
        return out

    p = np.where(w < 5, horner(ERFINV_CENTRE, w - f(2.5)), horner(ERFINV_TAIL, np.sqrt(w) - f(3)))
    return (f(math.sqrt(2)) * p * x).astype(f)


def normals(seed: int, step: int, nodes: int) -> np.ndarray:
    """(nodes, 3) standard normals that depend on (seed, step, node) alone."""
    counter = np.zeros((nodes, 4), np.uint64)
    counter[:, 0] = np.arange(nodes)
    return word_normals(philox(counter, (seed & 0xFFFFFFFF, step & 0xFFFFFFFF))[:, :3]).astype(float)


def langevin(nodes: DataFrame, springs: DataFrame, replicas: list[int], steps: int, dt: float = 0.02, friction: float = 1.0, kt: float = 0.6, stiffness: float = 1.0, mass: float = 1.0) -> DataFrame:
    """(replica, atom, x, y, z, temperature) after BAOAB steps; one task per replica (a seed)."""
    seeds = F.explode(F.array(*(F.lit(int(r)).cast("long") for r in replicas))).alias("replica")
    rows = nodes.select(seeds, "atom", *(F.col(c).cast("double") for c in "xyz"))
    edges = springs.select(seeds, "a", "b")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("atom", ignore_index=True)
        seed, n = int(left["replica"].iat[0]), len(left)
        at = {a: i for i, a in enumerate(left["atom"])}
        i, j = np.array([at[a] for a in right["a"]], int), np.array([at[b] for b in right["b"]], int)
        x = left[["x", "y", "z"]].to_numpy(float)
        rest = np.linalg.norm(x[i] - x[j], axis=1)
        v = normals(seed, 0, n) * math.sqrt(kt / mass)
        c1 = math.exp(-friction * dt)
        c2 = math.sqrt((1 - c1 * c1) * kt / mass)

        def force() -> np.ndarray:
            d = x[j] - x[i]
            size = np.maximum(np.linalg.norm(d, axis=1), 1e-9)
            f = (stiffness * (size - rest) / size)[:, None] * d
            out = np.zeros_like(x)
            np.add.at(out, i, f)
            np.add.at(out, j, -f)
            return out

        f = force()
        for step in range(1, steps + 1):
            v += 0.5 * dt / mass * f
            x += 0.5 * dt * v
            v = c1 * v + c2 * normals(seed, step, n)
            x += 0.5 * dt * v
            f = force()
            v += 0.5 * dt / mass * f
        return pd.DataFrame({"replica": seed, "atom": left["atom"], "x": x[:, 0], "y": x[:, 1], "z": x[:, 2], "temperature": mass * float((v**2).sum()) / (3 * n)})

    return rows.groupBy("replica").cogroup(edges.groupBy("replica")).applyInPandas(run, "replica long, atom long, x double, y double, z double, temperature double")


def component_centroids(atoms: DataFrame, parts: DataFrame) -> DataFrame:
    """(component, n, x, y, z): centroids of the components (node, component) of atoms."""
    rows = atoms.join(parts.withColumnRenamed("node", "atom"), "atom")
    return rows.groupBy("component").agg(F.count("*").alias("n"), *(F.avg(F.col(c).cast("double")).alias(c) for c in "xyz"))


def kinetic_temperature(velocities: DataFrame, masses: DataFrame | None = None, gas: float = 0.0019872043, degrees: int = 3) -> DataFrame:
    """(n, temperature): sum of m v squared over (degrees n R); velocities (atom, vx, vy, vz)."""
    rows = velocities.withColumn("mass", F.lit(1.0)) if masses is None else velocities.join(masses.select("atom", "mass"), "atom")
    v2 = F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz")
    return rows.agg(F.count("*").alias("n"), (F.sum(F.col("mass") * v2) / (F.count("*") * degrees * F.lit(gas))).alias("temperature"))


def residue_net_charge(residues: DataFrame, atoms: DataFrame, charge: str = "charge") -> DataFrame:
    """(residue, charge) of every residue, 0 where no atom has a charge."""
    sums = atoms.groupBy("residue").agg(F.sum(F.col(charge).cast("double")).alias("charge"))
    return residues.select("residue").join(sums, "residue", "left").select("residue", F.coalesce("charge", F.lit(0.0)).alias("charge"))


def assembly_copies(atoms_wide: DataFrame, instances: DataFrame) -> DataFrame:
    """Atoms once for each operator of their chain, moved by its matrix."""
    rows = atoms_wide.join(instances.select("chain", "operatorId", "transform"), "chain")
    moved = V.affine_column(F.col("transform"), V.vec())
    return rows.withColumns({c: v.cast("float") for c, v in zip("xyz", moved)}).drop("transform")
