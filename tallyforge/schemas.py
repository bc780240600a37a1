"""Vocabularies, decision tables and row types of catalogs, inventories and reconciled nodes."""

from __future__ import annotations

# --- fixed values: vocabularies, in their order ---
DAT_STATUS = ["InDatCollect", "InDatMerged", "InDatNoDump", "NotInDat", "InToSort", "InDatMIA"]
GOT_STATUS = ["NotGot", "Got", "Corrupt", "FileLocked"]
FILE_TYPE = {"UnSet": 0, "Dir": 1, "Zip": 2, "SevenZip": 3, "File": 4, "FileZip": 5, "FileSevenZip": 6, "FileOnly": 100}
ZIP_STRUCTURE = {"None": 0, "ZipTrrnt": 1, "ZipTDC": 2, "SevenZipTrrnt": 4, "ZipZSTD": 5, "SevenZipSLZMA": 8, "SevenZipNLZMA": 9, "SevenZipSZSTD": 10, "SevenZipNZSTD": 11}
REP_STATUS = ["Error", "UnSet", "UnScanned", "DirCorrect", "DirMissing", "DirUnknown", "DirInToSort", "DirCorrupt", "Missing", "Correct", "NotCollected", "UnNeeded", "Unknown", "InToSort", "Corrupt", "Ignore", "CanBeFixed", "MoveToSort", "Delete", "NeededForFix", "Rename", "CorruptCanBeFixed", "MoveToCorrupt", "Deleted", "MissingMIA", "CorrectMIA", "CanBeFixedMIA", "IncompleteRemove", "Incomplete", "EndValue"]
LEAF_TYPES = ["File", "FileZip", "FileSevenZip", "FileOnly"]
ARCHIVE_TYPES = ["Zip", "SevenZip"]
IN_CATALOG = ["InDatCollect", "InDatMerged", "InDatNoDump", "InDatMIA"]

# --- fixed values: base status by (dat_status, form) for Got, NotGot, Corrupt; all else is UnScanned ---
STATUS_MATRIX = {
    ("InDatCollect", "leaf"): ("Correct", "Missing", "Corrupt"),
    ("InDatCollect", "archive"): ("DirCorrect", "DirMissing", "DirCorrupt"),
    ("InDatCollect", "dir"): ("DirCorrect", "DirMissing", "DirCorrupt"),
    ("InDatMerged", "leaf"): ("UnNeeded", "NotCollected", "Corrupt"),
    ("InDatMerged", "archive"): ("UnNeeded", "NotCollected", "DirCorrupt"),
    ("InDatMerged", "dir"): ("DirCorrect", "DirMissing", "DirCorrupt"),
    ("InDatNoDump", "leaf"): ("UnNeeded", "NotCollected", "Corrupt"),
    ("InDatNoDump", "archive"): ("UnNeeded", "NotCollected", "DirCorrupt"),
    ("InDatNoDump", "dir"): ("DirCorrect", "DirMissing", "DirCorrupt"),
    ("InDatMIA", "leaf"): ("CorrectMIA", "MissingMIA", "Corrupt"),
    ("InDatMIA", "archive"): ("CorrectMIA", "MissingMIA", "DirCorrupt"),
    ("InToSort", "leaf"): ("InToSort", "Deleted", "Corrupt"),
    ("InToSort", "archive"): ("DirInToSort", "Deleted", "DirCorrupt"),
    ("InToSort", "dir"): ("DirInToSort", "Deleted", "DirCorrupt"),
    ("NotInDat", "leaf"): ("Unknown", "Deleted", "Corrupt"),
    ("NotInDat", "archive"): ("DirUnknown", "Deleted", "DirCorrupt"),
    ("NotInDat", "dir"): ("DirUnknown", "Deleted", "DirCorrupt"),
}
# --- fixed values: which statuses each counter counts, as file and as game ---
ACTIONS = ["CanBeFixed", "CanBeFixedMIA", "CorruptCanBeFixed", "MoveToSort", "MoveToCorrupt", "Delete", "Deleted", "NeededForFix", "Rename", "IncompleteRemove"]
FILE_COUNTERS = {
    "correct": ["Correct", "DirCorrect", "CorrectMIA"],
    "correct_mia": ["CorrectMIA"],
    "missing": ["Missing", "DirMissing", "MissingMIA", "Corrupt", "DirCorrupt", "Incomplete"],
    "missing_mia": ["MissingMIA"],
    "corrupt": ["Corrupt", "DirCorrupt", "Incomplete"],
    "fixes": ACTIONS,
    "in_to_sort": ["InToSort", "DirInToSort"],
    "not_collected": ["NotCollected"],
    "unneeded": ["UnNeeded"],
    "unknown": ["Unknown", "DirUnknown", "UnScanned"],
}
GAME_COUNTERS = {
    "correct": ["Correct", "DirCorrect", "CorrectMIA"],
    "missing": ["Missing", "DirMissing", "MissingMIA", "Corrupt", "DirCorrupt", "Incomplete"],
    "missing_mia": ["MissingMIA", "CorrectMIA"],
    "fixes": [*ACTIONS, "InToSort", "DirInToSort"],
}
# --- fixed values: order in which a directory shows the status of its members ---
DOMINANCE = ["Error", "UnSet", "UnScanned", "DirCorrupt", "MoveToCorrupt", "CorruptCanBeFixed", "CanBeFixedMIA", "CanBeFixed", "MoveToSort", "Delete", "NeededForFix", "Rename", "Corrupt", "Unknown", "UnNeeded", "Incomplete", "Missing", "MissingMIA", "CorrectMIA", "Correct", "InToSort", "NotCollected", "Ignore", "Deleted"]
# --- fixed values: status sets of reports ---
FIX_REPORT = ["CanBeFixed", "CanBeFixedMIA", "MoveToSort", "Delete", "NeededForFix", "Rename", "CorruptCanBeFixed", "MoveToCorrupt"]
PARTIAL_LISTING = ["UnScanned", "Missing", "Corrupt", "CanBeFixed", "CanBeFixedMIA", "CorruptCanBeFixed"]
ACTIONABLE = ["CanBeFixed", "CanBeFixedMIA", "CorruptCanBeFixed", "UnNeeded", "MoveToSort", "MoveToCorrupt", "Rename", "Delete", "IncompleteRemove"]
# --- fixed values: identities of empty content ---
EMPTY = {"crc": "00000000", "md5": "d41d8cd98f00b204e9800998ecf8427e", "sha1": "da39a3ee5e6b4b0d3255bfef95601890afd80709", "sha256": "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"}
# --- fixed values: header magics in order: type, offset, hex, bytes skipped ---
MAGICS = [
    ("ZIP", 0, "504B0304", 0), ("GZ", 0, "1F8B", 0), ("SEVEN_ZIP", 0, "377ABCAF271C", 0), ("RAR", 0, "526172211A0700", 0), ("CHD", 0, "4D436F6D70724844", 0),
    ("A7800", 1, "415441524937383030", 128), ("A7800", 100, "41435455414C20434152542044415441205354415254532048455245", 128), ("LYNX", 0, "4C594E58", 64), ("LYNX", 6, "425339", 64),
    ("NES", 0, "4E45531A", 16), ("FDS", 0, "4644531A", 16), ("PCE", 0, "4000000000000000AABB02", 512), ("PSID", 0, "50534944", 124), ("PSID", 0, "525349440002007C", 124),
    ("SNES", 0, "AABB040000000000", 512), ("SNES", 0, "535550455255464F", 512), ("SPC", 0, "534E45532D53504337303020536F756E642046696C65", 256),
]
ALT_CAPABLE = ["A7800", "FDS", "LYNX", "NES", "PCE", "PSID", "SNES", "SPC", "CHD"]
# --- fixed values: header rule files ---
HEADER_FILES = {"a7800.xml": "A7800", "no-intro_a7800.xml": "A7800", "lynx.xml": "LYNX", "no-intro_lnx.xml": "LYNX", "fds.xml": "FDS", "no-intro_fds.xml": "FDS", "no-intro_nes.xml": "NES", "nongoodnes.xml": "NES", "nes.xml": "NES", "nes0.xml": "NES", "pce.xml": "PCE", "psid.xml": "PSID", "snes.xml": "SNES", "spc.xml": "SPC"}
# --- fixed values: fault bits of an archive check ---
FAULT = {"corrupt": 2, "compression": 4, "separator": 8, "unsorted": 16, "extra_dirs": 32, "repeats": 64, "bad_compression": 128, "date": 256, "extra_data": 512, "comment": 1024, "name_case": 2048}
# --- fixed values: structure to (compression method, comment prefix, date policy) ---
STRUCTURES = {"ZipTrrnt": (8, "TORRENTZIPPED-", "fixed"), "ZipTDC": (8, "TDC-", "real"), "ZipZSTD": (93, "RVZSTD-", "zero"), "SevenZipSLZMA": (14, "", "real"), "SevenZipNLZMA": (14, "", "real"), "SevenZipSZSTD": (93, "", "real"), "SevenZipNZSTD": (93, "", "real"), "SevenZipTrrnt": (65535, "", "real")}
FIXED_DOS = (8600, 48128)
FIXED_DOS_PACKED = (8600 << 16) | 48128

CATALOG_NODE = (
    "dat_id bigint, node_id bigint, parent_id bigint, depth int, ord int, is_dir boolean, is_game boolean, name string, path array<string>, file_type string, dat_status string, "
    "date_modified bigint, size bigint, crc string, sha1 string, md5 string, sha256 string, merge string, status string, region string, mia string, is_disk boolean, "
    "game map<string,string>, category array<string>, device_ref array<string>"
)
