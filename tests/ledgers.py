"""Small ledgers made by hand."""

from ledgerloom.ledger import Ledger


def ledger(spark, txs, types=None, spks=None, locktimes=None, sequence=0):
    """txs: a list of (values, spends), spends being (tx number from 1, vout); spks and types: by (tx, vout)."""
    types, spks, locktimes = types or {}, spks or {}, locktimes or {}
    outs, ins, ids = [], [], {}
    for t, (values, _) in enumerate(txs, 1):
        for v, value in enumerate(values):
            ids[t, v] = len(outs)
            outs.append((len(outs), t, v, value, spks.get((t, v), 0), types.get((t, v), 0)))
    for t, (_, spends) in enumerate(txs, 1):
        for n, s in enumerate(spends):
            ins.append((len(ins), t, n, ids.get(s), sequence))
    tx = [(t, locktimes.get(t, 0), 0) for t in range(1, len(txs) + 1)]
    return (
        Ledger(
            spark.createDataFrame(tx, "tx_id long, locktime long, block_height long"),
            spark.createDataFrame(ins, "in_id long, tx_id long, vin long, prev_out_id long, sequence long"),
            spark.createDataFrame(outs, "out_id long, tx_id long, vout long, value long, spk long, output_type int"),
        ),
        ids,
    )


BASE = [([100, 150], []), ([150], []), ([100, 150], [(1, 0), (2, 0)])]


def flags(mask):
    return {r["key"]: r["flag"] for r in mask.collect()}


def clusters(clustering):
    out = {}
    for r in clustering.collect():
        out.setdefault(r["cluster_id"], set()).add(r["member"])
    assert all(k == min(v) for k, v in out.items())
    return sorted(map(sorted, out.values()))
