import io
import json
import struct

import pytest

from ledgerloom.functions import fingerprint_json, rawtx
from ledgerloom.functions.labels import amount_label
from ledgerloom.sources import blockindex, blocks


def compact(n):
    return bytes([n]) if n < 0xFD else b"\xfd" + struct.pack("<H", n)


def raw_tx(ins, outs, locktime=0, witness=None, version=2):
    """ins: (txid, vout, script, sequence); outs: (value, spk)."""
    body = compact(len(ins)) + b"".join(t + struct.pack("<I", v) + compact(len(s)) + s + struct.pack("<I", q) for t, v, s, q in ins)
    body += compact(len(outs)) + b"".join(struct.pack("<q", v) + compact(len(s)) + s for v, s in outs)
    head, tail = struct.pack("<i", version), struct.pack("<I", locktime)
    if witness is None:
        return head + body + tail
    return head + b"\0\1" + body + b"".join(compact(len(w)) + b"".join(compact(len(x)) + x for x in w) for w in witness) + tail


P2PKH = b"\x76\xa9\x14" + bytes(20) + b"\x88\xac"
P2WPKH = b"\x00\x14" + bytes(20)
P2TR = b"\x51\x20" + bytes(32)


def der(r, s=b"\x01"):
    body = b"\x02" + bytes([len(r)]) + r + b"\x02" + bytes([len(s)]) + s
    return b"\x30" + bytes([len(body)]) + body + b"\x01"


def test_parse_round_trip():
    plain = raw_tx([(bytes(32), 0xFFFFFFFF, b"\x01\x02", 7)], [(50, P2PKH)], locktime=9)
    with_witness = raw_tx([(bytes(32), 0xFFFFFFFF, b"\x01\x02", 7)], [(50, P2PKH)], locktime=9, witness=[[b"a", b""]])
    a, b = rawtx.parse_tx(plain), rawtx.parse_tx(with_witness)
    assert a.txid == b.txid == rawtx.sha256d(plain)
    assert a.is_coinbase and b.inputs[0].witness == [b"a", b""] and a.locktime == 9 and a.outputs[0].value == 50
    with pytest.raises(ValueError, match="behind"):
        rawtx.parse_tx(plain + b"x")
    with pytest.raises(ValueError, match="end"):
        rawtx.parse_tx(plain[:-1])


def test_fields(spark):
    """Decoded beside other columns; what is no transaction has nulls."""
    raw = raw_tx([(bytes([7]) * 32, 1, b"", 7)], [(50, P2PKH), (8, P2TR)], locktime=9)
    df = spark.createDataFrame([(1, raw), (2, raw[:-1]), (3, None)], "`a.fields` long, raw binary")
    a, b, c = (r.asDict() for r in rawtx.fields(df).orderBy("`a.fields`").collect())
    assert bytes(a["txid"]) == rawtx.sha256d(raw) and [a[k] for k in ("version", "locktime", "is_coinbase", "n_in", "n_out", "total")] == [2, 9, False, 1, 2, 58]
    assert all(b[k] is None and c[k] is None for k in ("txid", "version", "total")) and b["a.fields"] == 2


def test_signatures():
    low, high = der(b"\x11" * 32), der(b"\x00" + b"\x91" * 32)
    assert rawtx.der_r(low) == b"\x11" * 32 and rawtx.der_r(high) == b"\x91" * 32
    assert rawtx.der_r(b"\x30\x01") is None and rawtx.der_r(der(b"\x91" * 32)) is None
    i = lambda script=b"", witness=(): rawtx.TxIn(bytes(32), 0, script, 0, list(witness))
    assert rawtx.low_r(i(witness=[low])) and not rawtx.low_r(i(witness=[high])) and not rawtx.low_r(i())
    assert rawtx.low_r(i(bytes([len(low)]) + low))
    key = b"\x04" + bytes(64)
    assert rawtx.uncompressed_key(i(), bytes([65]) + key + b"\xac") and not rawtx.uncompressed_key(i(), b"\x21\x02" + bytes(32) + b"\xac")
    assert rawtx.uncompressed_key(i(bytes([65]) + key), P2PKH) and not rawtx.uncompressed_key(i(), P2PKH)
    assert rawtx.taproot_sighash(i(witness=[bytes(65)]), P2TR) and not rawtx.taproot_sighash(i(witness=[bytes(64)]), P2TR)
    assert rawtx.taproot_sighash(i(witness=[bytes(65), b"\x50x"]), P2TR) and not rawtx.taproot_sighash(i(witness=[bytes(65), b"x"]), P2TR)
    assert not rawtx.taproot_sighash(i(witness=[bytes(65)]), P2PKH)


def test_fingerprint_json(spark):
    prev = raw_tx([(bytes(32), 0xFFFFFFFF, b"\x01", 0)], [(10_000, P2WPKH), (5_000, P2PKH)])
    txid = rawtx.parse_tx(prev).txid
    tx = raw_tx([(txid, 0, b"", 0xFFFFFFFD), (txid, 1, b"", 0xFFFFFFFD)], [(3_000, P2PKH), (9_000, P2WPKH)], locktime=800_000, witness=[[der(b"\x11" * 32), b"k"], []])
    out = fingerprint_json.from_hex(tx.hex(), [prev.hex()])
    assert out["signals_rbf"] and out["anti_fee_snipe"] and out["output_structure"] == "double" and out["is_bip69_sorted"]
    assert out["mixed_input_types"] and out["address_reuse"] and out["input_order"] == ["descending", "bip69"]
    assert [i["low_r_grinding"] for i in out["inputs"]] == [True, False] and out["inputs"][0]["input_type"] == "p2wpkh"
    with pytest.raises(KeyError):
        fingerprint_json.from_hex(tx.hex(), [])
    rows = fingerprint_json.fingerprints(spark.createDataFrame([(tx.hex(),), ("zz",), (None,)], "hex string")).collect()
    assert json.loads(rows[0]["fingerprint"])["version"] == 2 and rows[1]["error"] and rows[2]["error"]


@pytest.mark.parametrize("key", [b"", bytes(8), bytes(range(1, 9))])
def test_block_reader(key):
    data = b"".join(b"MAGC" + struct.pack("<I", len(b)) + b for b in (b"first block", b"second"))
    stored = blocks.unmasked(data, key, 0)
    assert [b for _, b in blocks.iter_blocks(io.BytesIO(stored), key)] == [b"first block", b"second"]
    assert [at for at, _ in blocks.iter_blocks(io.BytesIO(stored), key)] == [8, 27]
    assert blocks.unmasked(stored[5:], key, 5) == data[5:]
    assert len(list(blocks.iter_blocks(io.BytesIO(blocks.unmasked(data + bytes(20), key, 0)), key, len(data)))) == 2
    with pytest.raises(EOFError):
        list(blocks.iter_blocks(io.BytesIO(stored), key, len(data) - 1))


def test_ledger_of_block_files(spark, tmp_path):
    def block(prev, nonce, *txs):
        header = struct.pack("<i", 1) + prev + bytes(32) + struct.pack("<III", 0, 0, nonce)
        return rawtx.sha256d(header), header + compact(len(txs)) + b"".join(txs)

    coinbase = lambda n: raw_tx([(bytes(32), 0xFFFFFFFF, bytes([n]), 0)], [(50, P2PKH), (1, P2WPKH)])
    a, raw_a = block(bytes(32), 1, coinbase(1))
    spend = raw_tx([(rawtx.parse_tx(coinbase(1)).txid, 0, b"", 0xFFFFFFFD)], [(49, P2TR)])
    b, raw_b = block(a, 2, coinbase(2), spend)
    _, fork = block(a, 3, coinbase(3))
    _, raw_c = block(b, 4, coinbase(4))
    key = bytes([9, 8, 7, 6, 5, 4, 3, 2])
    (tmp_path / "xor.dat").write_bytes(key)
    for n, some in enumerate(([raw_c, fork], [raw_b, raw_a])):  # not in the order of heights
        data = b"".join(b"MAGC" + struct.pack("<I", len(x)) + x for x in some)
        (tmp_path / f"blk{n:05d}.dat").write_bytes(blocks.unmasked(data, key, 0))
    g = blocks.read(spark, str(tmp_path))
    txs = {r["tx_id"]: r for r in g.tx.collect()}
    assert sorted(txs) == [0, 1, 2, 3] and [txs[k]["block_height"] for k in range(4)] == [0, 1, 1, 2]
    assert [txs[k]["is_coinbase"] for k in range(4)] == [True, True, False, True]
    spent = g.spent.where("prev_value IS NOT NULL").collect()
    assert [(r["tx_id"], r["prev_tx_id"], r["prev_value"]) for r in spent] == [(2, 0, 50)]
    assert sorted((r["out_id"], r["output_type"]) for r in g.txout.collect()) == [(0, 0), (1, 2), (2, 0), (3, 2), (4, 4), (5, 0), (6, 2)]
    tip = blocks.read(spark, str(tmp_path), depth=0)
    assert tip.tx.count() == 1 and tip.spent.where("prev_value IS NOT NULL").count() == 0
    from ledgerloom.operators.chain import ChainTooShort

    with pytest.raises(ChainTooShort):
        blocks.read(spark, str(tmp_path), depth=3)


def encode(n):
    out = [n & 0x7F]
    while n > 0x7F:
        n = (n >> 7) - 1
        out.append((n & 0x7F) | 0x80)
    return bytes(reversed(out))


def test_block_index():
    for n in (0, 1, 127, 128, 255, 16511, 16512, 9345, 2**32):
        assert blockindex.varint(encode(n)) == (n, len(encode(n)))
    header = struct.pack("<i", 1) + bytes(range(32)) + bytes(44)
    record = b"".join(map(encode, (1, 700_000, 8 | 16, 12, 3, 4567, 89))) + header
    assert blockindex.location(record) == blockindex.Location(700_000, 12, 3, 4567, bytes(range(32)))
    with pytest.raises(blockindex.NotStored):
        blockindex.location(b"".join(map(encode, (1, 5, 0, 1))) + header)
    info = blockindex.file_info(b"".join(map(encode, range(10, 17))))
    assert info.n_blocks == 10 and info.time_last == 16
    key = blockindex.obfuscation_key(b"\x02\x0f\xf0")
    assert blockindex.clear(blockindex.clear(b"value", key), key) == b"value" and blockindex.clear(b"v", b"") == b"v"
    infos = {0: blockindex.FileInfo(1, 1, 1, 0, 99, 0, 0), 1: blockindex.FileInfo(1, 1, 1, 90, 200, 0, 0)}
    assert blockindex.files_for(infos, 95, 97) == [0, 1] and blockindex.files_for(infos, 150, 300) == [1]


def test_amount_labels():
    assert [amount_label(n) for n in (0, 1, 3, 6, 18, 64, 100, 500, 2000, 54321)] == ["0", "2⁰", "3¹", "2×3¹", "2×3²", "2⁶", "10²", "5×10²", "2×10³", "54321"]


def test_chain_by_joins(spark, monkeypatch):
    """Forks, repeats and unknown parents, resolved in one task and by joins."""
    from ledgerloom.operators import chain

    name = lambda k: bytes([k])
    links = [(k, k - 1) for k in range(1, 14)] + [(20, 5), (21, 20), (30, 13), (31, 13), (40, 99), (7, 6)]
    df = spark.createDataFrame([(name(a), name(b)) for a, b in links], "block_hash binary, prev_hash binary")
    want = [(name(k), k - 1) for k in range(1, 14)] + [(name(30), 13)]
    for most in (chain.LOCAL, 0):
        monkeypatch.setattr(chain, "LOCAL", most)
        got = chain.heights(df).collect()
        assert sorted((bytes(r["block_hash"]), r["height"]) for r in got) == sorted(want)
    assert chain.heights(df.limit(0)).count() == 0
    assert chain.heights(df, 2).count() == 3
