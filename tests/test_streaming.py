import numpy as np
import pytest

from helpers import arrays, signal
from sigmaframe.operators import filtering as D
from sigmaframe.operators import radar as X
from sigmaframe.streaming import filters as S

R = np.random.default_rng(5)


def run(spark, tmp_path, blocks, schema, build):
    """Feeds blocks one micro-batch at a time and collects what the stream emits."""
    source = tmp_path / "in"
    source.mkdir()
    stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source)))
    got = []
    query = stream.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for k, block in enumerate(blocks):
            spark.createDataFrame(block, schema).coalesce(1).write.mode("append").json(str(source))
            query.processAllAvailable()
    finally:
        query.stop()
    return got


def by_key(rows, key):
    return np.array([r.v for r in sorted((r for r in rows if r.key == key), key=lambda r: r.i)])


def test_biquad_stream_equals_batch(spark, tmp_path):
    x = R.normal(size=(2, 30))
    chain = [D.design("lowpass", 3000, 48000), D.design("highpass", 100, 48000)]
    blocks = [[(c, int(t), float(x[c, t])) for c in (0, 1) for t in range(a, b)] for a, b in ((0, 11), (11, 12), (12, 30))]
    got = run(spark, tmp_path, blocks, "series int, i long, v double", lambda s: S.biquad_stream(s, "series", chain))
    want = arrays(D.biquad(signal(spark, x), ["series"], chain))
    for c in (0, 1):
        assert by_key(got, str(c)) == pytest.approx(want[c])


def test_resample_stream_equals_batch(spark, tmp_path):
    x, taps = np.sin(0.1 * np.arange(64)), [0.25, 0.5, 0.25, 0.1, -0.2]
    blocks = [[(0, int(t), float(x[t])) for t in range(a, b)] for a, b in ((0, 32), (32, 33), (33, 64))]
    got = run(spark, tmp_path, blocks, "series int, i long, v double", lambda s: S.resample_stream(s, "series", taps, 3, 2))
    assert by_key(got, "0") == pytest.approx(arrays(D.resample(signal(spark, [x]), ["series"], taps, 3, 2))[0])


def test_nlms_stream_equals_batch(spark, tmp_path):
    x, ref = R.normal(size=40), R.normal(size=40)
    blocks = [[(0, int(t), float(x[t]), float(ref[t])) for t in range(a, b)] for a, b in ((0, 3), (3, 25), (25, 40))]
    got = run(spark, tmp_path, blocks, "series int, i long, v double, ref double", lambda s: S.nlms_stream(s, "series", 5, 0.3))
    df = signal(spark, [x]).join(signal(spark, [ref], "ref"), ["series", "i"])
    assert by_key(got, "0") == pytest.approx(arrays(X.nlms(df, ["series"], 5, 0.3))[0])


def test_a_step_back_fails(spark, tmp_path):
    blocks = [[(0, 0, 1.0), (0, 1, 1.0)], [(0, 1, 2.0)]]
    with pytest.raises(Exception, match="positions must rise"):
        run(spark, tmp_path, blocks, "series int, i long, v double", lambda s: S.biquad_stream(s, "series", D.design("lowpass", 100, 1000)))
