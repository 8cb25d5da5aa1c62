"""Names, extension lists, sizes and texts that define the results. Nothing here is computed."""

# --- fixed values -----------------------------------------------------------------------------------------------

RAW_PHOTO_EXTENSIONS = [".cr2", ".cr3", ".nef", ".arw", ".raf", ".dng", ".rw2", ".orf", ".iiq", ".3fr"]
STANDARD_PHOTO_EXTENSIONS = [".jpg", ".jpeg", ".heic", ".heif", ".tif", ".tiff", ".png", ".webp"]
VIDEO_EXTENSIONS = [".mov", ".mp4", ".mxf", ".braw", ".r3d", ".avi", ".mts"]
SIDECAR_EXTENSIONS = [".xmp", ".thm", ".lrv"]

# Raw formats that are categorised but belong to no preset.
RAW_OUTSIDE_PRESETS = [".iiq", ".3fr"]

IGNORED_DIRECTORY_NAMES = [
    "$recycle.bin", "system volume information", ".trashes", ".fseventsd", ".spotlight-v100", ".git", ".github",
    "node_modules", ".cache", "#recycle", "@eadir", "appdata", ".thumbnails", ".trash", "__pycache__", ".zfs",
    "#snapshot", ".snapshots", ".recycle", "@recycle", ".temporaryitems", ".documentrevisions-v100",
]
IGNORED_DIRECTORY_PREFIX = ".trash-"
IGNORED_DIRECTORY_SUFFIXES = [".lrdata", ".photoslibrary", ".photolibrary", ".aplibrary", ".copkg"]

CATEGORIES = ["PhotoRaw", "PhotoStandard", "Video", "Sidecar", "Other"]
MODES = ["SuperFast", "Quick", "Deep", "Full"]
STATUSES = ["Verified", "Missing", "Corrupt", "Pending"]

KIB = 1024
MIB = 1024 * 1024
GIB = 1024 * 1024 * 1024
TIB = 1024 * 1024 * 1024 * 1024

HEAD_TAIL_BYTES = 64 * KIB
TIER1_MAX_BYTES = 4 * MIB
TIER2_MAX_BYTES = 128 * MIB
TIER2_SLICE_BYTES = 256 * KIB
TIER3_SLICE_BYTES = 1 * MIB
TIER2_POSITIONS = [0.25, 0.50, 0.75]
TIER3_POSITIONS = [0.10, 0.20, 0.35, 0.50, 0.65, 0.80, 0.90]

MTIME_TOLERANCE_MICROS = 2_000_000
MAX_COLLISION_SUFFIX = 10_000
EXIF_HEAD_BYTES = 256 * KIB

REASON_NO_SIZE = "No file found with matching byte size."
REASON_AMBIGUOUS = "Multiple candidates with identical size but differing filenames."
REASON_QUICK_CORRUPT = "Checksum mismatch on head/tail chunks."
REASON_QUICK_MISSING = "No candidate matched head/tail checksum."
REASON_DEEP_CORRUPT = "Probe checksum mismatch across interior and boundary slices."
REASON_DEEP_MISSING = "No candidate matched deep probe checksum."
REASON_FULL_EARLY = "Full file checksum mismatch detected in initial stream chunk."
REASON_FULL_CORRUPT = "Full file bit-for-bit checksum mismatch."
REASON_FULL_MISSING = "No candidate matched full file checksum."
REASON_IO_PREFIX = "I/O Error: "

COPY_FULL_MESSAGE = "Not copied: this destination ran out of space and has too little free space left for this file."
COPY_UNAVAILABLE_MESSAGE = "Not copied: this destination could not be reached after an earlier failure in this batch."

COPY_NO_NAME_MESSAGE = "All numbered names of '%s' up to 10000 are in use."
OVERLAP_SAME_MESSAGE = "Destination path cannot be identical to the source storage path."
OVERLAP_INSIDE_MESSAGE = "Destination path cannot be located inside the source storage path."

MODE_LABELS = {"SuperFast": "Super-Fast", "Quick": "Quick", "Deep": "Deep Probe", "Full": "Full"}
CATEGORY_LABELS = {
    "PhotoRaw": "RAW Photo",
    "PhotoStandard": "Standard Photo",
    "Video": "Video",
    "Sidecar": "Metadata Sidecar",
    "Other": "Other Media File",
}
FORMULA_TRIGGERS = ["=", "+", "-", "@", "\t", "\r"]

# --- end of fixed values ----------------------------------------------------------------------------------------

VERDICT_COLOURS = {"SafeToFormat": "seagreen", "PartiallyBackedUp": "goldenrod", "NoMediaFound": "gray", "UnsafeToFormat": "firebrick"}

PRESETS = {
    "Photos Only": [e for e in RAW_PHOTO_EXTENSIONS if e not in RAW_OUTSIDE_PRESETS] + STANDARD_PHOTO_EXTENSIONS,
}
PRESETS["Photos and Videos"] = PRESETS["Photos Only"] + VIDEO_EXTENSIONS
PRESETS["All Camera Media (with Sidecars)"] = PRESETS["Photos and Videos"] + SIDECAR_EXTENSIONS
