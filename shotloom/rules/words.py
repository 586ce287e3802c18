"""Fixed values of the language rules: vocabularies, lexicon, intensifiers and stop words, in their published order."""

SORT_TERMS = {
    "best": ("technical_quality", True), "highest quality": ("technical_quality", True),
    "best quality": ("technical_quality", True),
    "sharpest": ("sharpness", True), "brightest": ("brightness", True),
    "darkest": ("brightness", False), "longest": ("duration", True),
    "shortest": ("duration", False), "most energetic": ("visual_energy", True),
    "calmest": ("visual_energy", False),
}

CAMERA_TERMS = {
    "static": "static", "locked off": "static", "locked-off": "static",
    "tripod": "static", "still": "static",
    "pan": "pan", "panning": "pan", "pan left": "pan_left",
    "pan right": "pan_right", "whip pan": "pan",
    "tilt": "tilt", "tilt up": "tilt_up", "tilt down": "tilt_down",
    "push in": "push_in", "pushing in": "push_in", "dolly in": "push_in",
    "zoom in": "push_in",
    "pull out": "pull_out", "pulling out": "pull_out", "zoom out": "pull_out",
    "dolly out": "pull_out",
    "handheld": "handheld", "hand held": "handheld", "shaky": "handheld",
}

SIZE_TERMS = {
    "close up": "close_up", "closeup": "close_up", "close-up": "close_up",
    "cu": "close_up", "tight": "close_up",
    "medium": "medium", "mid shot": "medium", "medium shot": "medium",
    "wide": "wide", "wide shot": "wide", "establishing": "wide",
    "long shot": "wide",
}

FLAG_TERMS = {
    "with faces": "faces", "faces": "faces", "person": "faces",
    "people": "faces", "someone": "faces", "portrait": "faces",
    "talking": "speech", "speaking": "speech", "dialogue": "speech",
    "dialog": "speech", "speech": "speech", "interview": "speech",
    "voice": "speech", "talking head": "speech",
}

QUALITY_TERMS = {
    "sharp": ("sharpness", ">", 60.0, "sharpness above 60"),
    "soft": ("sharpness", "<", 30.0, "sharpness below 30"),
    "blurry": ("sharpness", "<", 20.0, "sharpness below 20"),
    "noisy": ("noise", ">", 0.12, "noise above the treatable threshold"),
    "grainy": ("noise", ">", 0.12, "noise above the treatable threshold"),
    "clean": ("noise", "<", 0.05, "noise below 0.05"),
    "compressed": ("blockiness", ">", 0.35, "visible compression blocking"),
    "high quality": ("technical_quality", ">", 0.6, "technical quality above 0.6"),
    "good quality": ("technical_quality", ">", 0.6, "technical quality above 0.6"),
    "poor quality": ("technical_quality", "<", 0.35, "technical quality below 0.35"),
    "bad quality": ("technical_quality", "<", 0.35, "technical quality below 0.35"),
    "usable": ("technical_quality", ">", 0.45, "technical quality above 0.45"),
}

SCALAR_TERMS = {
    "dark": ("brightness", "<", 0.35, "brightness below 0.35"),
    "low key": ("brightness", "<", 0.35, "brightness below 0.35"),
    "low-key": ("brightness", "<", 0.35, "brightness below 0.35"),
    "underexposed": ("brightness", "<", 0.28, "brightness below 0.28"),
    "bright": ("brightness", ">", 0.6, "brightness above 0.6"),
    "high key": ("brightness", ">", 0.6, "brightness above 0.6"),
    "high-key": ("brightness", ">", 0.6, "brightness above 0.6"),
    "overexposed": ("clipped_highlights", ">", 0.02, "blown highlights"),
    "warm": ("warmth", ">", 0.55, "warmth above 0.55"),
    "cold": ("warmth", "<", 0.45, "warmth below 0.45"),
    "cool": ("warmth", "<", 0.45, "warmth below 0.45"),
    "colourful": ("colorfulness", ">", 0.6, "colourfulness above 0.6"),
    "colorful": ("colorfulness", ">", 0.6, "colourfulness above 0.6"),
    "saturated": ("saturation", ">", 0.6, "saturation above 0.6"),
    "muted": ("saturation", "<", 0.4, "saturation below 0.4"),
    "flat": ("contrast", "<", 0.35, "contrast below 0.35"),
    "contrasty": ("contrast", ">", 0.65, "contrast above 0.65"),
    "energetic": ("visual_energy", ">", 0.6, "visual energy above 0.6"),
    "high energy": ("visual_energy", ">", 0.6, "visual energy above 0.6"),
    "calm": ("visual_energy", "<", 0.4, "visual energy below 0.4"),
    "quiet": ("visual_energy", "<", 0.4, "visual energy below 0.4"),
    "moving": ("subject_motion", ">", 3.0, "subject motion above 3.0"),
    "action": ("subject_motion", ">", 4.0, "subject motion above 4.0"),
}

QUERY_NEGATIONS = ("no ", "not ", "without ", "excluding ", "avoid ", "non-")
STOP_WORDS = ("the", "a", "an", "of", "in", "on", "with", "and", "or", "to",
              "shots", "shot", "clips", "clip", "footage", "find", "show",
              "me", "any", "all", "some", "that", "is", "are", "no", "not",
              "without", "excluding", "avoid", "give", "get", "look", "for")

# term: knob changes.  "*" multiplies, "+" adds, "transition:" sets a bias.
LEXICON = {
    "fast": {"*pacing_multiplier": 0.62, "+intensity_offset": 0.10},
    "faster": {"*pacing_multiplier": 0.62, "+intensity_offset": 0.10},
    "quick": {"*pacing_multiplier": 0.70},
    "rapid": {"*pacing_multiplier": 0.58, "+intensity_offset": 0.10},
    "snappy": {"*pacing_multiplier": 0.68},
    "punch": {"*pacing_multiplier": 0.78, "+intensity_gain": 0.15, "+effect_density": 0.1},
    "punchy": {"*pacing_multiplier": 0.70, "+effect_density": 0.10},
    "calmer": {"*pacing_multiplier": 1.3, "+intensity_gain": -0.15, "+effect_density": -0.1},
    "warmer": {"+warmth_delta": 0.25},
    "colder": {"+warmth_delta": -0.25},
    "cooler": {"+warmth_delta": -0.25},
    "moodier": {"+contrast_delta": 0.15, "+saturation_delta": -0.12},
    "breakneck": {"*pacing_multiplier": 0.48, "+intensity_offset": 0.18},
    "frantic": {"*pacing_multiplier": 0.52, "+intensity_offset": 0.18, "*continuity_weight": 0.7},
    "slow": {"*pacing_multiplier": 1.65, "+intensity_offset": -0.10},
    "slower": {"*pacing_multiplier": 1.65, "+intensity_offset": -0.10},
    "unhurried": {"*pacing_multiplier": 1.7, "+intensity_offset": -0.12},
    "patient": {"*pacing_multiplier": 1.6, "+intensity_offset": -0.10},
    "languid": {"*pacing_multiplier": 1.8, "+intensity_offset": -0.15},
    "meditative": {"*pacing_multiplier": 1.9, "+intensity_offset": -0.20, "+motion_preference": -0.35},
    "lingering": {"*pacing_multiplier": 1.7, "+motion_preference": -0.2},
    "energetic": {"+intensity_offset": 0.15, "+motion_preference": 0.30},
    "high-energy": {"+intensity_offset": 0.18, "+motion_preference": 0.35, "*pacing_multiplier": 0.75},
    "aggressive": {"+intensity_offset": 0.20, "+motion_preference": 0.35, "*continuity_weight": 0.65, "+effect_density": 0.18},
    "intense": {"*intensity_gain": 1.3, "+intensity_offset": 0.12},
    "explosive": {"+intensity_offset": 0.22, "+effect_density": 0.20, "*pacing_multiplier": 0.65},
    "chaotic": {"*continuity_weight": 0.45, "+diversity": 1.2, "+intensity_offset": 0.15, "*pacing_multiplier": 0.70,
                "+effect_density": 0.20},
    "frenetic": {"*pacing_multiplier": 0.55, "+intensity_offset": 0.18, "*continuity_weight": 0.6},
    "hype": {"+intensity_offset": 0.18, "+effect_density": 0.15, "*pacing_multiplier": 0.72},
    "calm": {"+intensity_offset": -0.18, "+motion_preference": -0.35, "*pacing_multiplier": 1.4},
    "gentle": {"+intensity_offset": -0.15, "+motion_preference": -0.30, "*pacing_multiplier": 1.35},
    "relaxed": {"+intensity_offset": -0.15, "*pacing_multiplier": 1.4},
    "serene": {"+intensity_offset": -0.20, "+motion_preference": -0.40, "*pacing_multiplier": 1.5},
    "moody": {"+contrast_delta": 0.10, "+saturation_delta": -0.12, "+intensity_offset": -0.05},
    "dreamy": {"*pacing_multiplier": 1.5, "+motion_preference": -0.25, "transition:dissolve": 2.2, "+saturation_delta": -0.05},
    "restrained": {"+effect_density": -0.28, "*continuity_weight": 1.35, "max_effects_per_clip": 2, "allow_shake": False,
                   "transition:flash": 0.35, "transition:whip": 0.5},
    "minimal": {"+effect_density": -0.32, "max_effects_per_clip": 2, "allow_shake": False, "transition:flash": 0.25,
                "transition:whip": 0.35},
    "understated": {"+effect_density": -0.28, "*continuity_weight": 1.3, "allow_shake": False, "transition:flash": 0.35,
                    "transition:whip": 0.5},
    "subtle": {"+effect_density": -0.25, "*continuity_weight": 1.25, "transition:flash": 0.4},
    "clean": {"+effect_density": -0.20, "*quality_weight": 1.35, "allow_grain": False},
    "polished": {"*quality_weight": 1.4, "+effect_density": -0.10},
    "raw": {"*quality_weight": 0.65, "allow_grain": True, "+effect_density": 0.05},
    "gritty": {"*quality_weight": 0.6, "allow_grain": True, "+contrast_delta": 0.12, "+saturation_delta": -0.15},
    "maximal": {"+effect_density": 0.32, "max_effects_per_clip": 5},
    "flashy": {"+effect_density": 0.28, "transition:flash": 2.0},
    "cinematic": {"*pacing_multiplier": 1.30, "*continuity_weight": 1.45, "+contrast_delta": 0.10, "+effect_density": -0.12,
                  "+motion_preference": -0.10, "transition:flash": 0.5},
    "filmic": {"*pacing_multiplier": 1.25, "*continuity_weight": 1.4, "+contrast_delta": 0.08},
    "documentary": {"*continuity_weight": 1.2, "+effect_density": -0.25, "*quality_weight": 0.9, "allow_shake": False},
    "vlog": {"*pacing_multiplier": 0.9, "+prefer_faces": 0.6},
    "trailer": {"*intensity_gain": 1.35, "+effect_density": 0.15, "transition:flash": 1.8},
    "montage": {"*pacing_multiplier": 0.8, "+diversity": 0.8},
    "music video": {"*pacing_multiplier": 0.8, "+effect_density": 0.12},
    "commercial": {"*quality_weight": 1.4, "+effect_density": -0.05},
    "vintage": {"allow_grain": True, "+saturation_delta": -0.15, "+warmth_delta": 0.20},
    "retro": {"allow_grain": True, "+warmth_delta": 0.18, "+saturation_delta": -0.10},
    "warm": {"+warmth_delta": 0.28},
    "cold": {"+warmth_delta": -0.28},
    "cool": {"+warmth_delta": -0.22},
    "vibrant": {"+saturation_delta": 0.28, "+contrast_delta": 0.08},
    "saturated": {"+saturation_delta": 0.28},
    "colourful": {"+saturation_delta": 0.25},
    "colorful": {"+saturation_delta": 0.25},
    "desaturated": {"+saturation_delta": -0.30},
    "muted": {"+saturation_delta": -0.25, "+contrast_delta": -0.05},
    "monochrome": {"+saturation_delta": -0.55},
    "bleak": {"+saturation_delta": -0.30, "+contrast_delta": 0.10},
    "high contrast": {"+contrast_delta": 0.22},
    "flat": {"+contrast_delta": -0.18},
    "dark": {"+contrast_delta": 0.12, "+saturation_delta": -0.08},
    "bright": {"+saturation_delta": 0.12},
    "intimate": {"shot_size_preference": "close_up", "+prefer_faces": 0.7, "*pacing_multiplier": 1.3},
    "close up": {"shot_size_preference": "close_up"},
    "close-up": {"shot_size_preference": "close_up"},
    "epic": {"shot_size_preference": "wide", "*pacing_multiplier": 1.25, "*intensity_gain": 1.2, "+contrast_delta": 0.10},
    "sweeping": {"shot_size_preference": "wide", "*pacing_multiplier": 1.35, "+motion_preference": 0.15},
    "wide": {"shot_size_preference": "wide"},
    "people": {"+prefer_faces": 0.7},
    "faces": {"+prefer_faces": 0.8},
    "portrait": {"+prefer_faces": 0.7, "shot_size_preference": "close_up"},
    "hard cuts": {"transition:cut": 2.2, "transition:dissolve": 0.2, "transition:whip": 0.4, "transition:flash": 0.5},
    "hard cut": {"transition:cut": 2.2, "transition:dissolve": 0.2},
    "straight cuts": {"transition:cut": 2.2, "transition:dissolve": 0.2},
    "whip": {"transition:whip": 2.4},
    "whips": {"transition:whip": 2.4},
    "whip pan": {"transition:whip": 2.6},
    "flash": {"transition:flash": 2.2},
    "flashes": {"transition:flash": 2.2},
    "strobe": {"transition:flash": 2.6, "+effect_density": 0.15},
    "dissolve": {"transition:dissolve": 2.4},
    "dissolves": {"transition:dissolve": 2.4},
    "crossfade": {"transition:dissolve": 2.4},
    "smooth transitions": {"transition:dissolve": 1.8, "*continuity_weight": 1.3},
    "jump cuts": {"*continuity_weight": 0.4, "+diversity": 0.8},
    "seamless": {"*continuity_weight": 1.6, "transition:dissolve": 1.4},
    "shake": {"allow_shake": True},
    "grain": {"allow_grain": True},
    "grainy": {"allow_grain": True, "+saturation_delta": -0.08},
    "effects": {"+effect_density": 0.15},
    "shaky": {"allow_shake": True, "+effect_density": 0.12},
    "handheld": {"allow_shake": True, "*quality_weight": 0.85},
    "smooth": {"allow_shake": False, "*continuity_weight": 1.3, "transition:whip": 0.4, "transition:flash": 0.4,
               "transition:dissolve": 1.6},
    "static": {"+motion_preference": -0.45, "allow_shake": False},
    "still": {"+motion_preference": -0.45},
    "kinetic": {"+motion_preference": 0.45},
    "dynamic": {"+motion_preference": 0.35},
    "movement": {"+motion_preference": 0.30},
}

INTENSIFIERS = {
    "very": 1.6, "extremely": 2.0, "really": 1.4, "super": 1.6, "ultra": 1.9,
    "highly": 1.5, "totally": 1.6, "insanely": 2.0, "incredibly": 1.8,
    "slightly": 0.45, "somewhat": 0.55, "a bit": 0.5, "a little": 0.45,
    "mildly": 0.5, "fairly": 0.75, "quite": 1.15, "rather": 0.9, "mostly": 1.1,
}
NEGATORS = ("not", "no", "never", "without", "avoid", "less", "isn't", "dont",
            "don't", "doesn't", "aren't", "minus", "except", "nothing")
CLAUSE_WORDS = ("and", "but", "then", "with", "however", "while")

ORDINALS = {"first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5,
            "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10,
            "1st": 1, "2nd": 2, "3rd": 3, "4th": 4, "5th": 5, "6th": 6,
            "7th": 7, "8th": 8, "9th": 9, "10th": 10}
ATTRIBUTE_WORDS = {
    "shaky": ("shake", "max"), "wobbly": ("shake", "max"), "handheld": ("shake", "max"),
    "dark": ("brightness", "min"), "darkest": ("brightness", "min"),
    "bright": ("brightness", "max"), "brightest": ("brightness", "max"),
    "blurry": ("sharpness", "min"), "softest": ("sharpness", "min"), "soft": ("sharpness", "min"),
    "noisy": ("noise", "max"), "grainy": ("noise", "max"),
    "sharpest": ("sharpness", "max"),
    "longest": ("duration", "max"), "shortest": ("duration", "min"),
}
LONGER = ("longer", "hold", "linger", "extend", "stretch", "breathe")
SHORTER = ("shorter", "tighten", "trim", "quicker", "snappier", "shorten")
EFFECT_WORDS = {
    "flash": "flash", "flashes": "flash", "whip": "whip", "whips": "whip",
    "shake": "shake", "shakes": "shake", "zoom": "push_zoom", "zooms": "push_zoom",
    "grade": "color_grade", "grading": "color_grade", "dissolve": "dissolve", "dissolves": "dissolve",
}
WHOLE_PIECE_HINTS = ("punch", "faster", "slower", "calmer", "energetic", "restrained",
                     "cinematic", "aggressive", "warmer", "colder", "moodier",
                     "brighter", "snappy", "chaotic", "smooth", "gentle")
NOTE_NEGATIONS = ("no ", "not ", "without ", "lose ", "drop ", "remove ", "kill ",
                  "get rid of ", "stop ", "less ")
ACTING_KNOBS = ("pacing_multiplier", "intensity_gain", "intensity_offset", "effect_density", "continuity_weight",
                "motion_preference", "warmth_delta", "contrast_delta", "saturation_delta", "diversity", "quality_weight")
