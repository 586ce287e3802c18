"""Fixed values of the sound plan, the delivery profiles, the review and the logs."""

LOUDNESS_TARGETS = {"social": -14.0, "broadcast": -23.0, "streaming": -16.0, "cinema": -27.0}
TRUE_PEAK_CEILING = -1.0
# (threshold, achieved dB)
DUCK_CALIBRATION = ((0.045, 2.6), (0.010, 6.5), (0.003, 6.9))
MAX_DUCK_DB = 6.9

# name, width, height, fps, loudness target, longest duration
PROFILES = (
    ("youtube_shorts", 1080, 1920, 30.0, "social", 180.0),
    ("tiktok", 1080, 1920, 30.0, "social", 600.0),
    ("instagram_reels", 1080, 1920, 30.0, "social", 90.0),
    ("youtube_1080p", 1920, 1080, 30.0, "social", None),
    ("broadcast_ebu", 1920, 1080, 25.0, "broadcast", None),
    ("web_preview", 720, 1280, 30.0, "social", None),
)
VIDEO_CODEC, PIX_FMT, SAMPLE_RATE, CHANNELS = "h264", "yuv420p", 48000, 2

PENALTY = {"high": 1.8, "medium": 1.0, "low": 0.4}
EXPLAIN_LIMIT = 2
CONCEPTS = ("fps", "pre_post_roll", "low_angle", "headroom", "handheld", "locked_off", "tracking", "white_balance")

# metric, relation, factor: how a restrained edit must differ from a chaotic one
AB_CHECKS = (
    ("mean_shot", ">", 1.25), ("clips", "<", 0.85), ("cuts_per_second", "<", 0.85), ("effects_per_clip", "<", 1.0),
    ("dissolve_share", ">", 1.0), ("showy_share", "<", 1.0), ("shake_effects", "absent", 0.0),
    ("pacing_multiplier", ">", 1.0), ("effect_density", "<", 1.0), ("continuity_weight", ">", 1.0),
)

# sequence, number, name, intensity, shortest recording, requirement, content
SHOT_SPECS = (
    ("skill", 1, "Approach", 0.3, 1.5, "static shot", "a person walking toward camera"),
    ("skill", 2, "Detail", 0.2, 1.5, "static sharp shot", "hands performing a small deliberate action"),
    ("skill", 3, "Object enters", 0.6, 2.0, "moving shot", "an object crossing frame close to the lens"),
    ("skill", 4, "The action", 1.0, 3.0, "energetic moving shot", "the skill or action being performed"),
    ("skill", 5, "Toward the lens", 0.9, 2.0, "energetic moving shot", "something travelling toward the lens"),
    ("skill", 6, "Release", 0.5, 2.5, "static shot", "a person reacting after the action"),
    ("arrival", 1, "Establish the place", 0.25, 3.0, "static wide shot", "an establishing view of a location"),
    ("arrival", 2, "A detail of the place", 0.2, 1.5, "static sharp shot", "a close detail"),
    ("arrival", 3, "The subject arrives", 0.5, 1.5, "static shot", "a person entering the frame"),
    ("arrival", 4, "Movement", 0.9, 3.0, "handheld moving shot", "following a subject"),
    ("arrival", 5, "Leave", 0.4, 2.5, "static wide shot", "a subject leaving frame"),
)

STAGES = {"Ingest": 0.15, "Analyzing music": 0.25, "Analyzing reference": 0.35, "Planning": 0.45, "Selecting": 0.55,
          "Rendering preview": 0.7, "Critique": 0.8, "Rendering final": 0.9, "Mastering": 0.97}
TERMINAL = ("succeeded", "failed", "cancelled")
INTERRUPTED = "interrupted: the process ended while this job was running, so its outcome is unknown"
