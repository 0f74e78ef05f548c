"""Country rules: key, display name, aliases that name the country as target, codes, aliases found in texts, top-level domains, phone prefixes."""

# Fixed values.
COUNTRIES = [
    ("argentina", "Argentina", ["argentina"], ["ar"], ["argentina", "buenos aires"], [".ar"], ["+54"]),
    ("espana", "España", ["espana", "españa", "spain"], ["es"], ["espana", "españa", "spain", "madrid", "barcelona", "valencia"], [".es"], ["+34"]),
    ("mexico", "México", ["mexico", "méxico"], ["mx"], ["mexico", "méxico", "cdmx", "ciudad de mexico", "ciudad de méxico"], [".mx"], ["+52"]),
    ("peru", "Perú", ["peru", "perú"], ["pe"], ["peru", "perú", "lima"], [".pe"], ["+51"]),
    ("colombia", "Colombia", ["colombia"], ["co"], ["colombia", "bogota", "bogotá"], [".co"], ["+57"]),
    ("chile", "Chile", ["chile"], ["cl"], ["chile", "santiago"], [".cl"], ["+56"]),
    ("uruguay", "Uruguay", ["uruguay"], ["uy"], ["uruguay", "montevideo"], [".uy"], ["+598"]),
    ("bolivia", "Bolivia", ["bolivia"], ["bo"], ["bolivia", "la paz", "santa cruz", "cochabamba"], [".bo"], ["+591"]),
]
