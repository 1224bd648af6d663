"""Names, breaks and formats that results depend on."""

# Bands of the observation table.
SWIR_BAND = "B12"
NIR_BAND = "B8A"
SCENE_COLLECTION = "sentinel-2-l2a"

# Missing-value marker of stored grids.
NODATA = -9999.0

# Severity classes, lowest first, with the edges of the two lowest.
SEVERITY_CLASSES = ("unburned", "low", "moderate", "high")
UNBURNED_FLOOR = -0.1
UNBURNED_CEILING = 0.1
DEFAULT_BREAKS = (0.27, 0.66)
CLASS_MIDPOINTS = {"unburned": 0.0, "low": 0.185, "moderate": 0.465, "high": 0.83}

# Replacement for a zero root and offset of the relativised denominators.
RDNBR_ZERO_ROOT = 0.001
RBR_OFFSET = 1.001

# Growth of the area of interest per side: a share of the extent, at most this many degrees.
BUFFER_SHARE = 0.2
BUFFER_MAX_DEGREES = 0.25

SQUARE_METRES_PER_HECTARE = 10000.0

# Catalogue vocabulary.
PRODUCT_SEVERITY = "fire_severity"
PRODUCT_BOUNDARY = "fire_boundary"
PRODUCT_MATRIX = "vegetation_fire_matrix"
ITEM_ID_INFIX = {
    PRODUCT_SEVERITY: "severity",
    PRODUCT_BOUNDARY: "boundary",
    PRODUCT_MATRIX: "veg-matrix",
}
STAC_VERSION = "1.0.0"
MEDIA_COG = "image/tiff; application=geotiff; profile=cloud-optimized"
MEDIA_GEOJSON = "application/geo+json"
MEDIA_JSON = "application/json"
MEDIA_CSV = "text/csv"
MEDIA_PARQUET = "application/vnd.apache.parquet"
RBR_TITLE = "Relativized Burn Ratio (RBR)"
MATRIX_ASSET_TITLE = "Vegetation Fire Severity Matrix"
MATRIX_ASSET_DESCRIPTION = (
    "CSV showing hectares of each vegetation type affected by fire severity classes"
)
MATRIX_DESCRIPTION = "Matrix of vegetation types affected by different fire severity classes"
RELATED_TITLE = "Related fire severity product"
UTC_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"

# Columns of the presented matrix.
MATRIX_COLUMNS = (
    "Color",
    "Vegetation Community",
    "Hectares",
    "% of Park",
    "% of Burn Area",
    "Mean Severity",
    "Std Dev",
)
