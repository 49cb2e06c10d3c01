"""One recorded region from its raw trace to its spikes, as fixed values, so that the chain is held against a recording wherever the tests run."""

import numpy as np
from pyspark.sql import functions as F

from tracesheaf.config import Settings
from tracesheaf.operators import deconv, events, traces
from tracesheaf.sources import sinks

# Mean intensity of a recorded region in each frame.
RAW = [
    4149.235, 4463.286, 4564.580, 4578.344, 4567.500, 4532.333, 4492.528, 4440.560, 4396.892, 4350.293, 4304.899, 4257.014, 4218.091, 4174.252, 4140.388,
    4096.710, 4063.396, 4028.545, 3998.964, 3974.434, 3952.722, 3929.600, 3903.129, 3889.384, 3874.694, 3846.895, 3836.504, 3824.011, 3815.909, 3813.195,
    3801.697, 3787.787, 3776.944, 3764.511, 3755.251, 3747.596, 3741.478, 3734.417, 3734.681, 3728.145, 3727.951, 3724.273, 3727.375, 3832.187, 4243.713,
    4421.867, 4467.726, 4478.298, 4454.204, 4424.659, 4394.347, 4354.426, 4307.198, 4265.934, 4224.621, 4179.302, 4148.200, 4115.973, 4087.595, 4056.480,
    4024.454, 3996.489, 3967.434, 3940.883, 3915.301, 3895.676, 3875.934, 3860.557, 3842.041, 3822.833, 3810.764, 3796.536, 3789.996, 3812.028, 3843.840,
    3861.522, 3848.031, 3834.950, 3820.143, 3804.006, 3788.737, 3776.744, 3769.142, 3751.295, 3754.435, 3734.765, 3731.038, 3726.527, 3717.511, 3712.409,
    3710.125, 3704.777, 3701.984, 3693.206, 3692.646, 3686.091, 3687.579, 3684.076, 3688.018, 3683.884, 3683.096, 3681.540, 3680.801, 3680.124, 3675.024,
    3676.011, 3669.551, 3670.055, 3669.989, 3661.930, 3660.832, 3659.192, 3660.159, 3661.862, 3699.637, 4067.038, 4296.621, 4402.442, 4435.536, 4424.878,
    4406.619, 4368.782, 4328.810, 4286.873, 4243.081, 4206.799, 4162.243, 4125.892, 4085.222, 4051.879, 4012.021, 3982.238, 3959.181, 3930.450, 3905.071,
    3883.348, 3865.340, 3847.686, 3828.648, 3820.920, 3811.896, 3795.688, 3785.644, 3774.946, 3768.504, 3754.624, 3745.325, 3737.680, 3724.313, 3723.548,
    3715.595, 3704.371, 3698.747,
]
# What was recorded for it at some frames, and its peaks.
FRAMES = [0, 4, 20, 47, 75, 100, 118, 152]
RECORDED = {
    "dff": [0.001067, 0.134617, 0.046540, 0.201213, 0.036225, 0.005799, 0.211279, -0.003029],
    "dec": [0.000000, 0.126837, 0.038760, 0.193433, 0.028445, 0.000669, 0.203499, 0.002151],
    "spikes": [0.000000, 0.023452, 0.003271, 0.030427, 0.009242, 0.000000, 0.037188, 0.000000],
    "thresholded": [0.000000, 0.023452, 0.003271, 0.030427, 0.009242, 0.000000, 0.037188, 0.000000],
}
PEAKS = [4, 47, 118]


def test_one_region_from_raw_trace_to_spikes(spark):
    long = traces.to_long(spark.createDataFrame([("B5_0000_p0", 1, RAW)], "fov string, roi int, trace array<double>"))
    r = traces.to_arrays(traces.delta_f(long, Settings().dff_window), "dff").withColumnRenamed("trace", "dff")
    r = deconv.deconvolve(r, "dff").cache()
    found = r.first()
    for name, digits in (("dff", 6), ("dec", 4), ("spikes", 4)):
        assert np.abs(np.array(found[name])[FRAMES] - RECORDED[name]).max() < 10.0**-digits, name
    r = events.detect_peaks(r.drop("peaks", "amplitudes"), "dec", Settings())
    assert r.first().peaks == PEAKS
    limit = events.spike_thresholds(traces.to_long(r, "spikes"), Settings()).select("fov", "roi", F.col("threshold").alias("inferred_spikes_threshold"))
    kept = sinks.thresholded(r.withColumn("inferred_spikes", F.col("spikes")).join(limit, ["fov", "roi"])).first().inferred_spikes
    assert [k > 0 for k in np.array(kept)[FRAMES]] == [w > 0 for w in RECORDED["thresholded"]]
