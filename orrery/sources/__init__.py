"""Where data comes from: configuration, manifests, images and cached features."""
