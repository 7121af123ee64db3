"""Explicit schemas; no input is ever inferred."""

ENTRIES = (
    "glottocode string, ipa string, gloss string, concepticon_id bigint, concepticon_gloss string, "
    "source string, segmented boolean, exclude string, linked_by string, seq bigint"
)
SOURCES = "id string, tier string, license string, kind string, dataset_ord int"
LANGUAGES = (
    "glottocode string, name string, alias string, macroarea string, latitude double, longitude double, "
    "doc_status string, prosodic_type string, family string, dataset_ord int, row bigint"
)

WORDLIST_FORMS = ("ID", "Language_ID", "Parameter_ID", "Form", "Value", "Segments")
WORDLIST_LANGUAGES = (
    "ID", "Name", "Glottocode", "Glottolog_Name", "Macroarea", "Latitude", "Longitude", "Family",
    "Doc_Status", "Prosodic_Type",
)
WORDLIST_PARAMETERS = ("ID", "Name", "Concepticon_ID", "Concepticon_Gloss")
