"""Fingerprints of single raw transactions, as JSON; for the command line and as a column function."""

from __future__ import annotations

import json
import sys

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerloom.arrow import by_cell
from ledgerloom.functions import rawtx
from ledgerloom.functions.scalars import RBF_BELOW
from ledgerloom.functions.scripts import NON_STANDARD, OP_RETURN, PATTERNS, TYPE_NAMES

STRUCTURES = {1: "single", 2: "double"}
ORDER_NAMES = {0: "single", 1: "ascending", 2: "descending", 3: "bip69", 5: "unknown"}


def type_of(spk: bytes) -> int:
    code = spk.hex()
    if code.startswith("6a"):
        return OP_RETURN
    return next((n for n, head, tail, size in PATTERNS if len(spk) == size and code.startswith(head) and code.endswith(tail)), NON_STANDARD)


def input_order(tx: rawtx.Tx, prevouts: list[rawtx.TxOut]) -> list[int]:
    if len(tx.inputs) == 1:
        return [0]
    amounts = [p.value for p in prevouts]
    points = [(i.prev_txid[::-1], i.prev_vout) for i in tx.inputs]
    differ = len(set(amounts)) > 1
    found = [1] * (differ and amounts == sorted(amounts)) + [2] * (differ and amounts == sorted(amounts, reverse=True)) + [3] * (points == sorted(points))
    return found or [5]


def fingerprint(tx: rawtx.Tx, prevouts: list[rawtx.TxOut] | None = None) -> dict:
    """The fingerprints; those that need the spent outputs only with them."""
    if prevouts is not None and len(prevouts) != len(tx.inputs):
        raise ValueError("one spent output for each input is needed")
    pairs = [(o.value, o.spk) for o in tx.outputs]
    out = {
        "version": tx.version,
        "signals_rbf": any(i.sequence < RBF_BELOW for i in tx.inputs),
        "anti_fee_snipe": tx.locktime != 0,
        "output_structure": STRUCTURES.get(len(tx.outputs), "multi"),
        "is_bip69_sorted": pairs == sorted(pairs),
    }
    inputs = [{"signals_rbf": i.sequence < RBF_BELOW, "low_r_grinding": rawtx.low_r(i)} for i in tx.inputs]
    if prevouts is not None:
        types = [type_of(p.spk) for p in prevouts]
        out["address_reuse"] = bool({p.spk for p in prevouts} & {o.spk for o in tx.outputs})
        out["mixed_input_types"] = len(set(types)) > 1
        out["input_order"] = [ORDER_NAMES[k] for k in input_order(tx, prevouts)]
        for d, i, p, t in zip(inputs, tx.inputs, prevouts, types, strict=True):
            d |= {"input_type": TYPE_NAMES[t], "has_uncompressed_pubkey": rawtx.uncompressed_key(i, p.spk), "taproot_keyspend_non_default_sighash": rawtx.taproot_sighash(i, p.spk)}
    return out | {"inputs": inputs, "outputs": [{"type": TYPE_NAMES[type_of(o.spk)]} for o in tx.outputs]}


def from_hex(spending: str, previous: list[str] | None = None) -> dict:
    """As above from hexadecimal transactions; the spent outputs are looked up in the previous ones by txid."""
    tx = rawtx.parse_tx(bytes.fromhex(spending.strip()))
    if previous is None:
        return fingerprint(tx)
    by_id = {t.txid: t for t in (rawtx.parse_tx(bytes.fromhex(p.strip())) for p in previous)}
    missing = [i.prev_txid[::-1].hex() for i in tx.inputs if i.prev_txid not in by_id]
    if missing:
        raise KeyError(f"previous transaction not given: {missing[0]}")
    return fingerprint(tx, [by_id[i.prev_txid].outputs[i.prev_vout] for i in tx.inputs])


FOUND = T.StructType([T.StructField("fingerprint", T.StringType()), T.StructField("error", T.StringType())])


def fingerprints(txs: DataFrame) -> DataFrame:
    """``txs`` with the fingerprint of each raw transaction (hex); what cannot be read has an error and no fingerprint."""

    def work(cells: pa.Array) -> pa.Array:
        found, errors = [], []
        for text in cells.to_pylist():
            try:
                found.append(json.dumps(from_hex(text)))
                errors.append(None)
            except (ValueError, TypeError, AttributeError) as e:
                found.append(None)
                errors.append(str(e))
        return pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(errors, pa.string())], names=[f.name for f in FOUND])

    return txs.withColumn("__found", by_cell(txs, "hex", work, FOUND)).select(*txs.columns, "__found.*")


def main(args: list[str]) -> int:
    """fingerprint_json HEX [PREVIOUS_HEX ...]"""
    if not args:
        print(main.__doc__, file=sys.stderr)
        return 2
    try:
        print(json.dumps(from_hex(args[0], args[1:] or None), indent=2))
    except (ValueError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
