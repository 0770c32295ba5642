"""Operators over voxel, label, region and track tables."""
