"""Machine types, class ids and class lists of the supported data sets."""

# Machine types per yearly anomaly data set and subset, in report order.
MACHINES = {
    "dcase20": {
        "dev": ["fan", "pump", "slider", "ToyCar", "ToyConveyor", "valve"],
        "eval": ["fan", "pump", "slider", "ToyCar", "ToyConveyor", "valve"],
    },
    "dcase21": {
        "dev": ["fan", "gearbox", "pump", "slider", "ToyCar", "ToyTrain", "valve"],
        "eval": ["fan", "gearbox", "pump", "slider", "ToyCar", "ToyTrain", "valve"],
    },
    "dcase22": {
        "dev": ["bearing", "fan", "gearbox", "slider", "ToyCar", "ToyTrain", "valve"],
        "eval": ["bearing", "fan", "gearbox", "slider", "ToyCar", "ToyTrain", "valve"],
    },
    "dcase23": {
        "dev": ["bearing", "fan", "gearbox", "slider", "ToyCar", "ToyTrain", "valve"],
        "eval": ["bandsaw", "grinder", "shaker", "ToyDrone", "ToyNscale", "ToyTank", "Vacuum"],
    },
    "dcase24": {
        "dev": ["bearing", "fan", "gearbox", "slider", "ToyCar", "ToyTrain", "valve"],
        "eval": [
            "3DPrinter", "AirCompressor", "BrushlessMotor", "HairDryer", "HoveringDrone",
            "RoboticArm", "Scanner", "ToothBrush", "ToyCircuit",
        ],
    },
    "dcase25": {
        "dev": ["bearing", "fan", "gearbox", "slider", "ToyCar", "ToyTrain", "valve"],
        "eval": [
            "AutoTrash", "BandSealer", "CoffeeGrinder", "HomeCamera",
            "Polisher", "ScrewFeeder", "ToyPet", "ToyRCCar",
        ],
    },
}

# Class order used to match file names, per fault data set.
GEARBOX_CLASSES = ["broken", "healthy", "missing_tooth", "root_crack", "wear"]
SHAFT_CLASSES = [
    "normal", "horizontal-misalignment", "vertical-misalignment", "imbalance",
    "overhang_ball_fault", "overhang_cage_fault", "overhang_outer_race",
    "underhang_ball_fault", "underhang_cage_fault", "underhang_outer_race",
]
BEARING_CLASSES = ["IF0.2", "IF0.4", "IF0.6", "NC", "OF0.2", "OF0.4", "OF0.6", "RF0.2", "RF0.4", "RF0.6"]
RACE_CLASSES = ["healthy", "IR", "OR"]
PLANET_CLASSES = [
    "normal", "planetrayfracture", "planetraypitting", "planetraywear",
    "sunfracture", "sunpitting", "sunwear",
]
GEAR_CLASSES = ["G1", "G2"]
ECCENTRIC_CLASSES = ["E00", "E02", "E04", "E06", "E08", "E10", "E12", "E14", "E16", "E18", "E20"]
AIR_CLASSES = [
    "tubeleak_noleak", "tubeleak_leak", "ventleak_noleak", "ventleak_leak", "ventlow_noleak", "ventlow_leak",
]

# Class ids are positions in these lists.
CLASS_IDS = {
    "compressed_air": AIR_CLASSES,
    "gearbox": GEARBOX_CLASSES,
    "shaft": sorted(SHAFT_CLASSES),
    "bearing": BEARING_CLASSES,
    "planet": PLANET_CLASSES,
    "gear": GEAR_CLASSES,
    "eccentric": ECCENTRIC_CLASSES,
    "race": RACE_CLASSES,
}

# Fields per file row of the ground-truth list; a machine row has one field.
TRUTH_FIELDS = {"dcase20": 3, "dcase21": 2, "dcase22": 2, "dcase23": 2, "dcase24": 2, "dcase25": 2}

# Suffixes of archives in link pages.
ARCHIVE_SUFFIXES = [".zip", ".rar", ".tar", ".gz", ".bz2", ".7z"]
