"""Default parameters, and the functional categories of orthologous groups."""

# Defaults of the analysis.
EVALUE_THRESHOLD = 1e-6
PRUNE_THRESHOLD = 0.25
ITERATIONS = 3
NEIGHBOURS = 20
HOPS = 3
COMPONENTS = 300
ALIGNMENT_THRESHOLD = 0.1
SUBSTITUTION_THRESHOLD = 0.3
CORRELATION_THRESHOLD = 0.3
PAIR_P_THRESHOLD = 1e-2
TRIANGLE_P_THRESHOLD = 1e-10
PAIR_LIMIT = 1000
WEIGHT_FLOOR = 0.2
EXPRESSION_FLOOR = 0.05
FDR_THRESHOLD = 0.25
P_THRESHOLD = 1e-3
EUKARYOTES = 2759

# Letters of the functional categories.
CATEGORIES = {
    "A": "RNA processing and modification",
    "B": "Chromatin structure and dynamics",
    "C": "Energy production and conversion",
    "D": "Cell cycle control, cell division, chromosome partitioning",
    "E": "Amino acid transport and metabolism",
    "F": "Nucleotide transport and metabolism",
    "G": "Carbohydrate transport and metabolism",
    "H": "Coenzyme transport and metabolism",
    "I": "Lipid transport and metabolism",
    "J": "Translation, ribosomal structure and biogenesis",
    "K": "Transcription",
    "L": "Replication, recombination, and repair",
    "M": "Cell wall membrane/envelope biogenesis",
    "N": "Cell motility",
    "O": "Post-translational modification, protein turnover, chaperones",
    "P": "Inorganic ion transport and metabolism",
    "Q": "Secondary metabolites biosynthesis, transport and catabolism",
    "R": "General function prediction only",
    "S": "Function unknown",
    "T": "Signal transduction mechanisms",
    "U": "Intracellular trafficking, secretion, and vesicular transport",
    "V": "Defense mechanisms",
    "W": "Extracellular structures",
    "Y": "Nuclear structure",
    "Z": "Cytoskeleton",
}
