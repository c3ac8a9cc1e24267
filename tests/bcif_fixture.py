"""A small writer of BinaryCIF bytes, with every encoding of the format."""

import struct

import numpy as np


def packed(v) -> bytes:
    if v is None:
        return b"\xc0"
    if isinstance(v, bool):
        return b"\xc3" if v else b"\xc2"
    if isinstance(v, (int, np.integer)):
        return struct.pack(">Bq", 0xD3, int(v))
    if isinstance(v, float):
        return struct.pack(">Bd", 0xCB, v)
    if isinstance(v, str):
        raw = v.encode()
        return (bytes([0xA0 | len(raw)]) if len(raw) < 32 else struct.pack(">BI", 0xDB, len(raw))) + raw
    if isinstance(v, bytes):
        return struct.pack(">BI", 0xC6, len(v)) + v
    if isinstance(v, list):
        return struct.pack(">BI", 0xDD, len(v)) + b"".join(map(packed, v))
    return struct.pack(">BH", 0xDE, len(v)) + b"".join(packed(k) + packed(x) for k, x in v.items())


def array(values, dtype: str, number: int) -> tuple[bytes, list]:
    return np.array(values, dtype).tobytes(), [{"kind": "ByteArray", "type": number}]


def packed_integers(values) -> tuple[bytes, list]:
    """Integer packing to signed bytes."""
    out = []
    for v in values:
        limit = 127 if v >= 0 else -128
        while (v >= limit) if v >= 0 else (v <= limit):
            out.append(limit)
            v -= limit
        out.append(v)
    data, enc = array(out, "i1", 1)
    return data, [{"kind": "IntegerPacking", "byteCount": 1, "isUnsigned": False, "srcSize": len(values)}, *enc]


def integers(values) -> dict:
    """Delta, run length and integer packing."""
    delta = np.diff(np.array(values, np.int64), prepend=values[0] if len(values) else 0)
    runs = []
    for d in delta.tolist():
        if runs and runs[-2] == d:
            runs[-1] += 1
        else:
            runs += [d, 1]
    data, enc = packed_integers(runs)
    head = [{"kind": "Delta", "origin": int(values[0]) if len(values) else 0, "srcType": 3}, {"kind": "RunLength", "srcType": 3, "srcSize": len(values)}]
    return {"data": data, "encoding": head + enc}


def decimals(values, factor=1000) -> dict:
    data, enc = array(np.round(np.array(values) * factor), "<i4", 3)
    return {"data": data, "encoding": [{"kind": "FixedPoint", "factor": factor, "srcType": 33}, *enc]}


def strings(values) -> dict:
    words = sorted({v for v in values})
    ends = np.cumsum([0, *map(len, words)]).tolist()
    data, enc = packed_integers([words.index(v) for v in values])
    offsets, oenc = array(ends, "<i4", 3)
    return {"data": data, "encoding": [{"kind": "StringArray", "dataEncoding": enc, "stringData": "".join(words), "offsetEncoding": oenc, "offsets": offsets}]}


def column(name: str, values: list) -> dict:
    mask = [0 if v not in (".", "?", None) else 2 if v == "?" else 1 for v in values]
    if all(isinstance(v, str) for v in values):
        data = strings(values)
    elif any(isinstance(v, float) for v in values):
        data = decimals([0.0 if m else v for v, m in zip(values, mask)])
    else:
        data = integers([0 if m else v for v, m in zip(values, mask)])
    out = {"name": name, "data": data}
    if any(mask):
        raw, enc = array(mask, "u1", 4)
        out["mask"] = {"data": raw, "encoding": enc}
    return out


def file(**tables: dict[str, list]) -> bytes:
    cats = [{"name": f"_{n}", "rowCount": len(next(iter(t.values()))), "columns": [column(c, v) for c, v in t.items()]} for n, t in tables.items()]
    return packed({"version": "0.3.0", "encoder": "test", "dataBlocks": [{"header": "TEST", "categories": cats}]})


def atom_site(rows: list[tuple]) -> dict[str, list]:
    """Rows of (model, asym, entity, seq, auth seq, comp, name, altloc, symbol, x, y, z, group)."""
    names = ("pdbx_PDB_model_num", "label_asym_id", "label_entity_id", "label_seq_id", "auth_seq_id", "label_comp_id", "label_atom_id", "label_alt_id", "type_symbol", "Cartn_x", "Cartn_y", "Cartn_z", "group_PDB")
    return {n: [r[i] for r in rows] for i, n in enumerate(names)} | {"id": [str(i + 1) for i in range(len(rows))], "auth_asym_id": [r[1].lower() for r in rows]}
