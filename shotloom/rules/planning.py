"""Fixed values of planning, selection, timeline building and validation."""

WEIGHTS = {
    "energy_fit": 0.22,
    "motion_fit": 0.16,
    "duration_fit": 0.12,
    "quality": 0.14,
    "creative": 0.12,
    "continuity": 0.18,
    "role_fit": 0.06,
}
REUSE_PENALTY = 0.34
SAME_ASSET_PENALTY = 0.07
CLOSE_CALL = 0.05

PUNCTUATION_LEN = 0.20
PUNCTUATION_RATIO = 0.6
PUNCTUATION_MAX = 0.45
MAX_SLOTS = 400

TRANSITION_SECONDS = {"whip": 0.13, "flash": 0.07, "dissolve": 0.22}
MIN_FIT = 0.25
MAX_TRANSITION_SHARE = 0.6

EFFECT_TYPES = ("push_zoom", "pull_zoom", "drift", "shake", "velocity_ramp", "directional_blur", "gaussian_blur",
                "radial_blur", "color_grade", "film_grain", "vignette", "glow", "flash", "denoise", "sharpen",
                "deblock", "stabilize", "expand_contrast", "reframe")
TRANSITION_TYPES = ("cut", "whip", "flash", "dissolve", "zoom", "slide", "match_movement")
RESTORATION = ("deblock", "denoise", "expand_contrast", "sharpen", "stabilize")

# effect.parameter: (lowest, highest)
PARAM_RANGES = {
    "push_zoom.from": (0.5, 3.0), "push_zoom.to": (0.5, 3.0),
    "pull_zoom.from": (0.5, 3.0), "pull_zoom.to": (0.5, 3.0),
    "directional_blur.strength": (0.0, 1.0), "directional_blur.angle": (-360.0, 360.0),
    "gaussian_blur.strength": (0.0, 1.0), "radial_blur.strength": (0.0, 1.0),
    "shake.amplitude": (0.0, 0.12), "shake.frequency": (0.1, 30.0),
    "velocity_ramp.from": (0.1, 8.0), "velocity_ramp.to": (0.1, 8.0),
    "film_grain.strength": (0.0, 1.0), "vignette.strength": (0.0, 1.0),
    "glow.strength": (0.0, 1.0), "flash.strength": (0.0, 1.0),
    "color_grade.contrast": (0.0, 3.0), "color_grade.saturation": (0.0, 3.0),
    "color_grade.brightness": (-1.0, 1.0), "color_grade.gamma": (0.1, 3.0),
    "color_grade.temperature": (-1.0, 1.0),
    "drift.dx": (-0.5, 0.5), "drift.dy": (-0.5, 0.5),
    "reframe.x": (0.0, 1.0), "reframe.y": (0.0, 1.0), "reframe.scale": (0.2, 3.0),
    "denoise.strength": (0.0, 1.0), "sharpen.strength": (0.0, 1.0), "deblock.strength": (0.0, 1.0),
    "stabilize.strength": (0.0, 1.0), "stabilize.zoom": (0.0, 0.2),
    "expand_contrast.strength": (0.0, 1.0),
}
MAX_EFFECTS_PER_CLIP = 5
MIN_CLIP_DURATION = 0.08
BEAT_TOLERANCE = 0.055

STAGE_ORDER = {
    "stabilize": -5, "deblock": -4, "denoise": -3, "sharpen": -2, "expand_contrast": -1,
    "reframe": 0, "push_zoom": 1, "pull_zoom": 1, "drift": 2, "shake": 3,
    "directional_blur": 4, "radial_blur": 4, "gaussian_blur": 4,
    "color_grade": 5, "flash": 6, "glow": 7, "vignette": 8, "film_grain": 9,
}
UNKNOWN_STAGE = 5
KEEP_PRIORITY = {
    "reframe": 0, "color_grade": 1, "push_zoom": 2, "pull_zoom": 2, "directional_blur": 3,
    "shake": 4, "film_grain": 5, "vignette": 6, "glow": 7,
}
UNKNOWN_PRIORITY = 9

# Constraint knobs with their neutral values and allowed ranges.
KNOBS = {
    "pacing_multiplier": (1.0, 0.35, 3.0),
    "min_shot_floor": (0.12, 0.10, 1.5),
    "max_shot_ceiling": (4.0, None, 8.0),
    "intensity_gain": (1.0, 0.3, 2.2),
    "intensity_offset": (0.0, -0.5, 0.5),
    "motion_preference": (0.0, -1.0, 1.0),
    "continuity_weight": (1.0, 0.2, 2.5),
    "quality_weight": (1.0, 0.3, 2.5),
    "diversity": (0.0, 0.0, 3.0),
    "prefer_faces": (0.0, -1.0, 1.0),
    "effect_density": (0.5, 0.0, 1.0),
    "max_effects_per_clip": (4, 0, 5),
    "motion_effect_threshold": (0.42, 0.0, 1.0),
    "max_transition_share": (0.6, 0.0, 0.85),
    "contrast_delta": (0.0, -0.4, 0.4),
    "saturation_delta": (0.0, -0.6, 0.6),
    "warmth_delta": (0.0, -0.6, 0.6),
}
BIAS_RANGE = (0.0, 4.0)
