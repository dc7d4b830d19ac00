"""Column functions over reads: flags, CIGAR, bases, bins, intervals, variants, tags."""
