"""Canonical schemas. Times are 100 ns ticks in longs; hashes are unsigned 32-bit words in longs."""

TRACKS = (
    "track_id long, name string, channels int, sample_rate int, bit_depth int, format string, length_ticks long, offset_ticks long, "
    "locked boolean, mute boolean, solo boolean, volume double, balance double, inverted_phase boolean, mono_downmix boolean"
)
SAMPLES = "track_id long, channel int, idx long, value float"
FRAMES = "track_id long, frame_idx long, values array<float>"
HASHES = "track_id long, idx long, hash long, is_variation boolean"
MATCHES = "track1 long, track2 long, t1 long, t2 long, similarity double, source string"
WARPS = "track_id long, from_t long, to_t long"
PATH = "pair_id long, step int, i1 long, i2 long, t1 long, t2 long"
