"""Cell covers: quadtree cells on a Hilbert curve, and Web-Mercator tiles."""
