"""Fixed values of the shot measures: thresholds, weights and names, in their published order."""

MOVES = ("static", "pan_left", "pan_right", "tilt_up", "tilt_down", "push_in", "pull_out", "handheld", "complex")

DEFECT_THRESHOLDS = {
    "noise": 0.12,
    "softness": 0.30,
    "shake": 1.60,
    "blockiness": 0.35,
    "underexposed": 0.030,
    "overexposed": 0.030,
    "low_contrast": 0.30,
}
STEADY_FROM = 0.55

ROLE_MAX_DURATION = {
    "flash_frame": 0.20,
    "transition": 0.35,
    "rapid_montage": 0.50,
    "texture": 1.20,
    "background": 2.50,
}
REALISABLE = ("flash_frame", "transition", "rapid_montage")
BRIEF_SECONDS = 0.30

THIRDS = (1 / 3, 2 / 3)
SIZE_EDGES = (0.12, 0.28)
ASPECTS = (("9:16", 9 / 16), ("1:1", 1.0), ("4:5", 0.8), ("16:9", 16 / 9), ("4:3", 4 / 3), ("2.39:1", 2.39))
ASPECT_TOLERANCE = 0.06
PROXY_HEIGHT = 540
PROXY_BITRATE = 20_000_000
